"""A live HTTP source for pages, off unless it is registered: spark.read.format("webloom_http").option("urls", ...)."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from webloom.schema import CAPTURES


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webloom_http"

    def schema(self):
        return CAPTURES

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.accept = options.get("accept", "text/html")
        self.seconds = float(options.get("timeout", "30"))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        import http.client
        import urllib.error
        import urllib.request

        # follows up to ten redirects, with the cookies that they set
        opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor())
        try:
            request = urllib.request.Request(partition.value, headers={"Accept": self.accept})
            with opener.open(request, timeout=self.seconds) as answer:
                yield (partition.value, self.accept, "plain", answer.url, answer.status, answer.headers.get("Content-Type"), answer.read())
        except urllib.error.HTTPError as e:  # a status of its own is a result
            yield (partition.value, self.accept, "plain", partition.value, e.code, e.headers.get("Content-Type"), e.read())
        except (OSError, ValueError, http.client.HTTPException):  # no such host, no answer in time, no address: a row without a status
            yield (partition.value, self.accept, "plain", partition.value, None, None, None)
