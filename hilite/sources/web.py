"""Fields of pages and answers of web interfaces, from columns of text. What fetches them is a parameter."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEASONS = "struct<code: int, message: string, result: struct<list: array<struct<season_id: string, title: string, cover: string, is_finish: int, pub_time: int, total_count: int, week: string, url: string, newest_ep_index: string>>>>"
SEASON = "struct<code: int, message: string, result: struct<tags: array<struct<tag_name: string>>, episodes: array<struct<av_id: string, index: string, webplay_url: string>>>>"


def found(text: Column, *patterns: str, otherwise: str | None = None) -> Column:
    """The first group of the first pattern that matches with something in it."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns), F.lit(otherwise))


def html_fields(html: Column, url: Column) -> dict[str, Column]:
    """Title, keywords and breadcrumb tags (packed with tabs), the pool's id by three patterns, else -1, and the video's id from the address."""
    return {
        "title": found(html, r"(?s)<h1[^>]*>(?:<span>)?([^<]*)<", r"(?s)<title>(.*?)</title>"),
        "metakeywords": F.replace(found(html, r'<meta name="keywords" content="([^"]*)"'), F.lit(","), F.lit("\t")),
        "tags": F.array_join(F.regexp_extract_all(html, F.lit(r"property=[\"']v:title[\"']>([^<]*)<"), F.lit(1)), "\t"),
        "cid": found(html, r"cid=(\d+)", r"cid='?(\d+)", r'"cid":\s*"?(\d+)', otherwise="-1"),
        "aid": found(url, r"/av(\d+)"),
    }


# The identifiers of a page's counters, in the order of the page.
COUNTERS = {"dianji": "views", "dm_count": "comments", "v_ctimes": "coins", "stow_count": "favourites"}


def counters(html: Column) -> Column:
    """STRUCT<views, comments, coins, favourites> of a video's page as text, all of them or null."""
    block = r'(?s)<div\s+class="v-title-info">' + "".join(rf'.*?<span\s+id="{name}">(.*?)</span>' for name in COUNTERS) + ".*?</div>"
    got = F.struct(*(F.regexp_extract(html, block, i).alias(name) for i, name in enumerate(COUNTERS.values(), 1)))
    return F.when(html.rlike(block), got)


def listed_pages(html: Column) -> Column:
    """The number of pages that a listing tells in its pager, null where it has none."""
    return F.regexp_extract(html, r'(?s)<div class="pagelistbox">.*?<a class="p endPage"[^>]*>(\d+)</a>', 1).try_cast("int")


def listing(html: Column, least: int = 100) -> Column:
    """ARRAY<STRUCT<url, comments>> of a listing's videos with at least least comments."""
    pattern = r'<a href="([^"]+)"[^>]*>[^<]*</a>\s*<i class="dm" number="(\d+)"'
    both = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("comments"))
    return F.filter(F.transform(both, lambda x: F.struct(x.url.alias("url"), x.comments.try_cast("int").alias("comments"))), lambda x: x.comments >= least)


def page_urls(url: Column, pages: Column) -> Column:
    """ARRAY<STRING> of the addresses of pages 1 to pages, for addresses that end in _1.html or -1.html; none for others."""
    numbers = F.when(pages >= 1, F.sequence(F.lit(1), pages)).otherwise(F.array().cast("array<int>"))
    styles = F.when(url.rlike(r"_\d+\.html$"), "_").when(url.rlike(r"-\d+\.html$"), "-")
    stem = F.regexp_replace(url, r"[_-]\d+\.html$", "")
    return F.when(styles.isNotNull(), F.transform(numbers, lambda i: F.concat(stem, styles, i.cast("string"), F.lit(".html")))).otherwise(F.array().cast("array<string>"))


def page_count(rows: Column, per_page: int = 30) -> Column:
    return F.ceil(rows / per_page).cast("int")


def season_rows(df: DataFrame, json: str) -> DataFrame:
    """A row for each season of answers with code 0 and message success; fields that are missing are null."""
    parsed = df.select(*(c for c in df.columns if c != json), F.from_json(json, SEASONS).alias("a"))
    return parsed.where((F.col("a.code") == 0) & (F.col("a.message") == "success")).select(*(c for c in df.columns if c != json), F.inline("a.result.list"))


def season_tags(json: Column) -> Column:
    """A season's tags packed with tabs."""
    a = F.from_json(json, SEASON)
    return F.when((a.code == 0) & (a.message == "success"), F.array_join(F.transform(a.result.tags, lambda t: t.tag_name), "\t"))


def season_episodes(df: DataFrame, json: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c != json), F.from_json(json, SEASON).alias("a")).where((F.col("a.code") == 0) & (F.col("a.message") == "success")).select(*(c for c in df.columns if c != json), F.inline("a.result.episodes"))


def room_json(html: Column, schema: str = "struct<room_id: string, room_name: string, owner_name: string>") -> Column:
    """The room's record embedded in its page; null where it is no JSON."""
    return F.from_json(F.regexp_extract(html, r"(?s)\$ROOM\s*=\s*(\{.*?\});", 1), schema)


def server_list(html: Column) -> Column:
    """ARRAY<STRUCT<ip, port>> of the servers in a page, written as encoded JSON."""
    return F.from_json(F.try_url_decode(F.regexp_extract(html, r'"server_config":"([^"]*)"', 1)), "array<struct<ip: string, port: string>>")


def fetch(urls: DataFrame, url: str, get: Callable[[str], bytes], *, tries: int = 5) -> DataFrame:
    """urls with content: what get returns, as text without what isn't UTF-8, after at most tries attempts; empty on failure."""
    import gzip
    import zlib

    def inflated(data: bytes) -> bytes:
        for how in (gzip.decompress, zlib.decompress, lambda d: zlib.decompress(d, -zlib.MAX_WBITS)):
            try:
                return how(data)
            except (OSError, zlib.error, EOFError):
                continue
        return data

    def one(u: str | None) -> str:
        for _ in range(tries if u else 0):
            try:
                return inflated(get(u)).decode("utf-8", "ignore")
            except Exception:  # noqa: BLE001, S112
                continue
        return ""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[one(u) for u in b[url]])

    return urls.mapInPandas(pages, ", ".join(f"`{c}` {k}" for c, k in urls.dtypes) + ", content string")
