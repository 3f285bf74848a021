"""The adapter tier over captures: route, join the answer of the adapter's API, render, and go on to the next adapter where one
declines. What comes out are candidate rows for the waterfall."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import segments
from webloom.operators import adapters as A

TIER, SOURCE = 4, "adapter"


def _at(url: Column, i: int) -> Column:
    return F.get(segments(url), F.lit(i))


@dataclass(frozen=True)
class Adapter:
    """Which URLs it claims, where it asks, and what it makes of an answer (url, body, readme): markdown or null to decline, and a title.
    `plain` says for which URLs an answer needn't be JSON."""

    name: str
    claims: Callable[[Column], Column]
    asks: Callable[[Column], Column]
    markdown: Callable[[Column, Column, Column], Column]
    title: Callable[[Column, Column], Column]
    plain: Callable[[Column], Column] = lambda url: F.lit(False)


def _github(url: Column, body: Column, readme: Column) -> Column:
    kind = _at(url, 2)
    issue = A.github_issue(body, kind == "pull")
    return F.when(F.size(segments(url)) == 2, A.github_readme(body)).when(kind == "blob", A.non_blank(body)).otherwise(issue)


def _github_title(url: Column, body: Column) -> Column:
    repo = F.concat(_at(url, 0), F.lit("/"), _at(url, 1))
    named = F.get_json_object(body, "$.title")
    file = F.concat(repo, F.lit(": "), F.array_join(F.slice(segments(url), 5, F.greatest(F.size(segments(url)), F.lit(1))), "/"))
    return F.when(F.size(segments(url)) == 2, F.concat(repo, F.lit(" README"))).when(_at(url, 2) == "blob", file).otherwise(named)


def package(url: Column) -> Column:
    """The package that an npm or PyPI page is about."""
    scoped = F.concat(_at(url, 1), F.lit("/"), _at(url, 2))
    return F.when(_at(url, 1).startswith("@"), scoped).otherwise(_at(url, 1))


def _thread(url: Column) -> Column:
    return (F.size(segments(url)) >= 4) & (_at(url, 0) == "r") & (_at(url, 2) == "comments")


def _reddit(url: Column, body: Column, readme: Column) -> Column:
    sub = F.coalesce(_at(url, 1), F.lit("frontpage"))
    return F.when(_thread(url), A.reddit_thread(body)).otherwise(A.reddit_listing(sub, body))


def _reddit_title(url: Column, body: Column) -> Column:
    listing = F.concat(F.lit("r/"), F.coalesce(_at(url, 1), F.lit("frontpage")))
    return F.when(_thread(url), F.get_json_object(body, "$[0].data.children[0].data.title")).otherwise(listing)


def _wiki_title(url: Column, body: Column) -> Column:
    rest = F.array_join(F.slice(segments(url), 2, F.greatest(F.size(segments(url)), F.lit(1))), "/")
    return F.translate(F.try_url_decode(rest), "_", " ")


def _of(name: str) -> Callable[[Column], Column]:
    return lambda url: F.coalesce(A.adapter(url) == name, F.lit(False))


#: In the order in which they are asked.
ADAPTERS = (
    Adapter("github", _of("github"), A.api_url, _github, _github_title, lambda url: F.coalesce(_at(url, 2) == "blob", F.lit(False))),
    Adapter("wikipedia", _of("wikipedia"), A.api_url, lambda url, body, readme: A.wikipedia_page(url, body), _wiki_title, lambda url: F.lit(True)),
    Adapter("hackernews", _of("hackernews"), A.api_url, lambda url, body, readme: A.hn_thread(body), lambda url, body: F.get_json_object(body, "$.title")),
    Adapter("reddit", _of("reddit"), A.api_url, _reddit, _reddit_title),
    Adapter("npm", _of("npm"), A.api_url, lambda url, body, readme: A.npm_package(package(url), body, readme), lambda url, body: package(url)),
    Adapter("pypi", _of("pypi"), A.api_url, lambda url, body, readme: A.pypi_project(_at(url, 1), body), lambda url, body: _at(url, 1)),
)


def asked(urls: DataFrame, adapters: tuple[Adapter, ...] = ADAPTERS) -> DataFrame:
    """(url, rank, adapter, api): for each URL the adapters that claim it, in order, with the address that each asks; an adapter that
    declines the path asks nowhere and is left out."""
    url, asks = F.col("url"), list(dict.fromkeys(a.asks for a in adapters))
    # each kind of address is made once, whichever adapters share it
    made = urls.select("url").distinct().select("url", *[ask(url).alias(f"ask{k}") for k, ask in enumerate(asks)])
    own = [(i, a, F.col(f"ask{asks.index(a.asks)}")) for i, a in enumerate(adapters)]
    rows = F.array(*[F.when(api.isNotNull() & a.claims(url), F.struct(F.lit(i).alias("rank"), F.lit(a.name).alias("adapter"), api.alias("api"))) for i, a, api in own])
    return made.select("url", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("url", "r.*")


def attempts(urls: DataFrame, captures: DataFrame, readmes: DataFrame | None = None, adapters: tuple[Adapter, ...] = ADAPTERS) -> DataFrame:
    """(url, rank, adapter, api, outcome, markdown, title) of every adapter that claims a URL.

    captures: (url, status, body) of API addresses, of which the first by status and body counts; readmes: (package, readme)
    where the registry gives none (adapters.readme_fallback). outcome: `missing` (no capture), `failed` (a status of 400 or
    more, or a null body), `declined` (nothing to render, or JSON that can't be read) or `ok`.
    """
    rows = asked(urls, adapters)
    body = captures.groupBy(F.col("url").alias("api")).agg(F.min(F.struct("status", "body")).alias("c"))
    got = rows.join(body, "api", "left")
    if readmes is None:
        got = got.withColumn("readme", F.lit(None).cast("string"))
    else:
        got = got.join(readmes.withColumnRenamed("package", "of"), (F.col("adapter") == "npm") & (package(F.col("url")) == F.col("of")), "left")
    answered = (F.col("c.status") < 400) & F.col("c.body").isNotNull()
    url, text, readme = F.col("url"), F.col("text"), F.col("readme")
    got = got.select("url", "rank", "adapter", "api", "readme", F.col("c").isNull().alias("missing"), F.when(answered, F.col("c.body")).alias("text"))
    # JSON is checked once an answer, in a column of its own
    plain = F.lit(False)
    for a in adapters:
        plain = F.when(F.col("adapter") == a.name, a.plain(url)).otherwise(plain)
    got = got.withColumn("read", F.when(plain | F.try_parse_json(text).isNotNull(), text))
    # each renderer gets the answers of its own URLs, and null elsewhere: one pass, whatever runs in Arrow
    markdown, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a in adapters:
        own = F.when(F.col("adapter") == a.name, F.col("read"))
        markdown = F.when(F.col("adapter") == a.name, F.when(own.isNotNull(), a.markdown(url, own, readme))).otherwise(markdown)
        title = F.when(F.col("adapter") == a.name, a.title(url, text)).otherwise(title)
    made = got.select("url", "rank", "adapter", "api", "missing", "text", A.non_blank(markdown).alias("markdown"), title.alias("title"))
    outcome = F.when(F.col("missing"), "missing").when(text.isNull(), "failed").when(F.col("markdown").isNull(), "declined").otherwise("ok")
    return made.select("url", "rank", "adapter", "api", outcome.alias("outcome"), "markdown", F.when(F.col("markdown").isNotNull(), F.col("title")).alias("title"))


def adapter_tier(urls: DataFrame, captures: DataFrame, readmes: DataFrame | None = None, adapters: tuple[Adapter, ...] = ADAPTERS) -> DataFrame:
    """(url, tier, source, markdown, title): for each URL what the first adapter gives that neither fails nor declines. URLs without
    one have no row, so that the waterfall's next tiers decide."""
    won = attempts(urls, captures, readmes, adapters).where("outcome = 'ok'")
    first = won.groupBy("url").agg(F.min_by(F.struct("markdown", "title"), "rank").alias("x")) if len(adapters) > 1 else won.select("url", F.struct("markdown", "title").alias("x"))
    return first.select("url", F.lit(TIER).alias("tier"), F.lit(SOURCE).alias("source"), F.col("x.markdown").alias("markdown"), F.col("x.title").alias("title"))
