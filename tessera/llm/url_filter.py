"""Operator 9 [native]: URL filters by a temporal list join.

A list is a log of dated entries ``(key, action, since)``.  A key is a host suffix (``example.com`` covers
its subdomains) or a host with leading path segments (``a.example.com/en``).  An entry holds from its day
to the day before the key's next entry; ``remove`` ends a key's listing.  Every capture meets the entries
active on its fetch day, and the most specific active key decides (longer path, then more labels, then
smaller key): ``allow`` on a path overrides ``block`` on its domain.

Only DataFrame functions.  Captures are first reduced to distinct (key, day, salt), so that a host
with a third of all captures costs at most days x salts rows in the as-of join, and come back through
the same three columns, spread over the salts.  Entries per key are at most one a day.

Defined cases: url null or without scheme and host: ``unparsed``; fetch day null: ``undated``; no active
key: ``unlisted``; entries with null key, day or an unknown action are ignored; several entries of a key
on one day: block wins over allow over remove; repeated captures are judged each; an empty list or table
works; keys compare in lower case for the host and as written for the path; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^\[/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
SALTS = 32


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without the dot that may end it; an address in brackets keeps them.  Null if it has none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, PATH, 1), "/", -1), lambda s: s != "")


def suffix_keys(host: Column) -> Column:
    """The host and its parents of two labels at least (an address in digits or brackets only itself)."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    first = F.when(host.rlike(r"^[0-9.]+$|^\["), 1).otherwise(F.greatest(n - 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), first), lambda i: F.struct(
        (n - i + 1).alias("rank"), F.array_join(F.slice(labels, i, n), ".").alias("key")))


def path_keys(host: Column, segments: Column, depth: int) -> Column:
    """The host with 1 .. ``depth`` leading path segments."""
    n = F.least(F.size(segments), F.lit(depth))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda j: F.struct(
        (j * 1000).alias("rank"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), j), "/")).alias("key")))
    ).otherwise(F.array().cast("array<struct<rank:int,key:string>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``key, action, since, until`` (until exclusive, null: still valid)."""
    rank = F.expr("CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 WHEN 'remove' THEN 0 END")
    day = (entries.select("key", F.col("since").cast("date").alias("since"), rank.alias("rank"))
           .where("key IS NOT NULL AND since IS NOT NULL AND rank IS NOT NULL")
           .groupBy("key", "since").agg(F.max("rank").alias("rank")))
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return (day.withColumn("until", until).where("rank > 0")
            .select("key", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"), "since", "until"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
          day_col: str = "fetch_date") -> DataFrame:
    """``page_id, url, host, fetch_date, decision, rule_key, rule_since, n_active`` of every capture."""
    caps = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("fetch_date"))
    caps, _ = C.numbered(caps.withColumn("host", host_of(F.col("url"))), "captures")
    depth = entries.agg(F.max(F.length("key") - F.length(F.replace("key", F.lit("/"))))).first()[0] or 0
    keys = F.concat(suffix_keys(F.col("host")), path_keys(F.col("host"), segments_of(F.col("url")), int(depth)))
    flat = (caps.where("host IS NOT NULL AND fetch_date IS NOT NULL")
            .select("row_id", "fetch_date", F.explode(keys).alias("k")).select("row_id", "fetch_date", "k.*")
            .withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")))
    asked = flat.select("key", "fetch_date", "salt").distinct()
    listed = intervals(entries)
    active = asked.join(listed, "key").where("fetch_date >= since AND (until IS NULL OR fetch_date < until)")
    hit = (flat.join(active.select("key", "fetch_date", "salt", "action", "since"), ["key", "fetch_date", "salt"])
           .groupBy("row_id").agg(F.min_by(F.struct("key", "action", "since"), F.struct(-F.col("rank"), "key")).alias("hit"),
                                  F.count(F.lit(1)).alias("n")))
    out = caps.join(hit, "row_id", "left")
    decision = (F.when(F.col("host").isNull(), "unparsed").when(F.col("fetch_date").isNull(), "undated")
                .when(F.col("hit").isNull(), "unlisted").when(F.col("hit.action") == "block", "blocked").otherwise("allowed"))
    return out.select("page_id", "url", "host", "fetch_date", decision.alias("decision"), F.col("hit.key").alias("rule_key"),
                      F.col("hit.since").alias("rule_since"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"))


# The registered query's inputs, derived from ``pages``: fetch days from the page id, and list entries from
# the md5 of every host, parent domain and first path segment that occurs.

START = "2024-01-01"


def fetches(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(f"date_add(DATE'{START}', CAST(pmod(page_id, 366) AS INT))").alias("fetch_date"))


def derived_list(pages: DataFrame) -> DataFrame:
    """``key, action, since``: about a third of the keys are listed, with one to three dated entries."""
    host = host_of(F.col("url"))
    known = F.concat(suffix_keys(host), path_keys(host, segments_of(F.col("url")), 1))
    keys = pages.where(host.isNotNull()).select(F.explode(known).alias("k")).select("k.key").distinct()

    def byte(i: int) -> Column:
        return F.conv(F.substring(F.md5("key"), 2 * i + 1, 2), 16, 10).cast("int")
    a, b, c, e = byte(0), byte(1), byte(2), byte(3)
    log = F.array(
        F.when(a < 96, F.struct(F.lit("block").alias("action"), b.alias("day"))),
        F.when((a < 96) & (c >= 64), F.struct(F.when(c % 2 == 0, "remove").otherwise("allow").alias("action"), (b + 1 + c % 60).alias("day"))),
        F.when(a < 32, F.struct(F.lit("block").alias("action"), (b + 61 + e % 60).alias("day"))),
        F.when(a >= 224, F.struct(F.lit("allow").alias("action"), F.floor(b / 2).cast("int").alias("day"))))
    return (keys.select("key", F.explode(log).alias("x")).where("x IS NOT NULL")
            .select("key", "x.action", F.expr(f"date_add(DATE'{START}', x.day)").alias("since")))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^\[/?#:@]+)', 1)), '\.$', ''), '') AS host,
         regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]+') AS seg,
         CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetch_date
  FROM pages),
lab AS (SELECT *, string_split(host, '.') AS labels FROM p WHERE host IS NOT NULL),
suf AS (
  SELECT page_id, fetch_date, labels, unnest(range(1, CASE WHEN regexp_matches(host, '^[0-9.]+$|^\[') THEN 2 ELSE greatest(len(labels) - 1, 1) + 1 END)) AS i FROM lab),
keyed AS (
  SELECT page_id, fetch_date, len(labels) - i + 1 AS rank, array_to_string(labels[i:], '.') AS key FROM suf
  UNION ALL
  SELECT page_id, fetch_date, 1000, host || '/' || seg FROM lab WHERE seg <> ''),
m AS (
  SELECT key, CAST('0x' || substr(md5(key), 1, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(key), 3, 2) AS INTEGER) AS b,
         CAST('0x' || substr(md5(key), 5, 2) AS INTEGER) AS c, CAST('0x' || substr(md5(key), 7, 2) AS INTEGER) AS e
  FROM (SELECT DISTINCT key FROM keyed)),
log AS (
  SELECT key, 2 AS act, b AS day FROM m WHERE a < 96
  UNION ALL SELECT key, CASE WHEN c % 2 = 0 THEN 0 ELSE 1 END, b + 1 + c % 60 FROM m WHERE a < 96 AND c >= 64
  UNION ALL SELECT key, 2, b + 61 + e % 60 FROM m WHERE a < 32
  UNION ALL SELECT key, 1, b // 2 FROM m WHERE a >= 224),
per_day AS (SELECT key, day, max(act) AS act FROM log GROUP BY key, day),
iv AS (SELECT key, act, day, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM per_day),
act AS (
  SELECT k.page_id, k.key, i.act, CAST(DATE '2024-01-01' + i.day AS DATE) AS since,
         row_number() OVER (PARTITION BY k.page_id ORDER BY k.rank DESC, k.key) AS pos, count(*) OVER (PARTITION BY k.page_id) AS n
  FROM keyed k JOIN iv i ON i.key = k.key AND i.act > 0
   AND k.fetch_date >= CAST(DATE '2024-01-01' + i.day AS DATE) AND (i.until IS NULL OR k.fetch_date < CAST(DATE '2024-01-01' + i.until AS DATE)))
SELECT p.page_id, p.url, p.host, p.fetch_date,
       CASE WHEN p.host IS NULL THEN 'unparsed' WHEN a.key IS NULL THEN 'unlisted' WHEN a.act = 2 THEN 'blocked' ELSE 'allowed' END AS decision,
       a.key AS rule_key, a.since AS rule_since, coalesce(a.n, 0) AS n_active
FROM p LEFT JOIN act a ON a.page_id = p.page_id AND a.pos = 1"""
