"""URL filters with dated lists: validity intervals and an as-of join (``op7_temporal_url_filter``).

List entries (list, role 'block' or 'allow', kind, key, action 'add' or 'remove', at) are changes of a list; at is in
seconds. Between an entry and the next one of the same list, kind and key the first one's action holds, so
the adds become half-open validity intervals. A capture (page_id, url, fetched_at) is tested against the keys of
its url: kind 'domain' for the host and each of its parent domains, kind 'path' for the host with each
prefix of whole path segments. The join takes the intervals of these keys in which the fetch time lies:
the entries active when the page was fetched, not those of today. A capture is blocked if a block rule
is active and no allow rule is.

All of it is DataFrame functions. A host may hold a third of all captures: captures are spread over ``SALTS``
parts of their key, to which the intervals are copied, and matches are aggregated per capture before they join
the captures again.

Defined cases: null urls, and urls without scheme and host, match nothing; hosts compare in lower case; a
null fetch time matches nothing; entries with a null list, kind, key or time are ignored; of several actions at
one time 'remove' wins; a repeated add or remove changes nothing; repeated captures get a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlprism.llm.common import table

SALTS = 8
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[^?#]*?://[^/?#]*/([^?#]*)"


def validity(entries: DataFrame) -> DataFrame:
    """(list, role, kind, key, since, until): intervals in which an entry is on its list; open ones have no until."""
    changes = entries.where("list IS NOT NULL AND kind IS NOT NULL AND key IS NOT NULL AND at IS NOT NULL") \
        .groupBy("list", "role", "kind", "key", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "role", "kind", "key").orderBy("at")
    return changes.withColumn("until", F.lead("at").over(order)).where("action = 'add'") \
        .select("list", "role", "kind", "key", F.col("at").alias("since"), "until")


def host(url):
    return F.lower(F.regexp_extract(url, HOST, 1))


def keys(url):
    """Array of (kind, key) that a url is tested against."""
    labels = F.split(host(url), r"\.")
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)),
                          lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key")))
    paths = F.when(F.size(segments) > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))),
        lambda i: F.struct(F.lit("path").alias("kind"), F.concat(host(url), F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("key"))))
    return F.when(host(url) != "", F.concat(domains, F.coalesce(paths, F.array().cast("array<struct<kind:string,key:string>>"))))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, host, n_rules, lists, blocked) per capture."""
    rows = captures.select("page_id", "url", "fetched_at")
    tested = rows.where("page_id IS NOT NULL AND url IS NOT NULL AND fetched_at IS NOT NULL").distinct() \
        .select("page_id", "url", "fetched_at", F.explode(keys(F.col("url"))).alias("k")) \
        .select("page_id", "url", "fetched_at", "k.kind", "k.key", F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(SALTS)).alias("salt"))
    intervals = validity(entries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    active = tested.join(intervals, ["kind", "key", "salt"]).where("since <= fetched_at AND (until IS NULL OR fetched_at < until)")
    found = active.groupBy("page_id", "url", "fetched_at").agg(
        F.count(F.lit(1)).alias("rules"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("on_lists"),
        F.max(F.col("role") == "block").alias("block"), F.max(F.col("role") == "allow").alias("allow"))
    return rows.join(found, ["page_id", "url", "fetched_at"], "left").select(
        "page_id", "url", "fetched_at", F.nullif(host(F.col("url")), F.lit("")).alias("host"),
        F.coalesce("rules", F.lit(0)).cast("long").alias("n_rules"), F.coalesce("on_lists", F.lit("")).alias("lists"),
        F.coalesce(F.col("block") & ~F.col("allow"), F.lit(False)).alias("blocked"))


def _number(text):
    """A number below 2^24 from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def stand_in(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and list entries in the operator's schema, from ``pages``, which has neither fetch times nor lists: a fetch time
    within 2024 from the page's id; for some hosts, their parent domains and first path segments a dated add, and for
    some of those a later removal and a second add."""
    day = 86400
    captures = pages.select("page_id", "url", (F.lit(1704067200) + _number(F.col("page_id").cast("string")) % (366 * day)).alias("fetched_at"))
    hosts = pages.select(host(F.col("url")).alias("h"), F.regexp_extract("url", PATH, 1).alias("p")).where("h <> ''")
    named = (hosts.select(F.lit("spam").alias("list"), F.lit("block").alias("role"), F.lit("domain").alias("kind"), F.col("h").alias("key"))
             .unionByName(hosts.where(F.size(F.split("h", r"\.")) > 2).select(F.lit("parents").alias("list"), F.lit("block").alias("role"), F.lit("domain").alias("kind"),
                                                                             F.regexp_replace("h", r"^[^.]*\.", "").alias("key")))
             .unionByName(hosts.where(F.substring_index("p", "/", 1) != "").select(F.lit("paths").alias("list"), F.lit("block").alias("role"), F.lit("path").alias("kind"),
                                                         F.concat("h", F.lit("/"), F.substring_index("p", "/", 1)).alias("key")))
             .unionByName(hosts.select(F.lit("trusted").alias("list"), F.lit("allow").alias("role"), F.lit("domain").alias("kind"), F.col("h").alias("key")))
             ).distinct().withColumn("n", _number(F.concat("list", F.lit(" "), F.col("key")))).where("n % 4 = 0")
    at = F.lit(1704067200) + F.col("n") % (200 * day)
    entries = named.withColumn("at", at).withColumn("action", F.lit("add"))
    entries = entries.unionByName(named.where("n % 8 = 0").withColumn("at", at + 40 * day).withColumn("action", F.lit("remove"))) \
        .unionByName(named.where("n % 16 = 0").withColumn("at", at + 90 * day).withColumn("action", F.lit("add"))).drop("n")
    return captures, entries


def op7_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture with the rules active when it was fetched."""
    return filter_captures(*stand_in(table(spark, sf_dir, "pages"))).select("page_id", "fetched_at", "host", "n_rules", "lists", "blocked")


ORACLES = {"op7_temporal_url_filter": r"""
WITH c AS (SELECT page_id, url, 1704067200 + ('0x' || substr(md5(page_id::VARCHAR), 1, 6))::BIGINT % (366 * 86400) AS fetched_at,
                  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS h,
                  regexp_extract(url, '^[^?#]*?://[^/?#]*/([^?#]*)', 1) AS p FROM pages),
named AS (SELECT 'spam' AS list, 'block' AS role, 'domain' AS kind, h AS key FROM c WHERE h <> ''
          UNION SELECT 'parents', 'block', 'domain', regexp_replace(h, '^[^.]*\.', '') FROM c WHERE len(string_split(h, '.')) > 2
          UNION SELECT 'paths', 'block', 'path', h || '/' || string_split(p, '/')[1] FROM c WHERE h <> '' AND string_split(p, '/')[1] <> ''
          UNION SELECT 'trusted', 'allow', 'domain', h FROM c WHERE h <> ''),
numbered AS (SELECT *, ('0x' || substr(md5(list || ' ' || key), 1, 6))::BIGINT AS n FROM named),
entries AS (SELECT list, role, kind, key, 1704067200 + n % (200 * 86400) AS at, 'add' AS action FROM numbered WHERE n % 4 = 0
            UNION ALL SELECT list, role, kind, key, 1704067200 + n % (200 * 86400) + 40 * 86400, 'remove' FROM numbered WHERE n % 8 = 0
            UNION ALL SELECT list, role, kind, key, 1704067200 + n % (200 * 86400) + 90 * 86400, 'add' FROM numbered WHERE n % 16 = 0),
labels_of AS (SELECT *, string_split(h, '.') AS l, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM c WHERE h <> ''),
tested AS (SELECT page_id, fetched_at, 'domain' AS kind, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.'))) AS key FROM labels_of
           UNION ALL SELECT page_id, fetched_at, 'path', unnest(list_transform(range(1, len(s) + 1), lambda i: h || '/' || array_to_string(s[1:i], '/'))) FROM labels_of),
latest AS (SELECT t.page_id, t.kind, t.key, e.list, e.role, arg_max(e.action, e.at) AS action
           FROM tested t JOIN entries e ON t.kind = e.kind AND t.key = e.key AND e.at <= t.fetched_at GROUP BY ALL),
found AS (SELECT page_id, count(*) AS rules, string_agg(DISTINCT list, ',' ORDER BY list) AS on_lists, bool_or(role = 'block') AS block, bool_or(role = 'allow') AS allow
          FROM latest WHERE action = 'add' GROUP BY page_id)
SELECT c.page_id, c.fetched_at, nullif(c.h, '') AS host, coalesce(rules, 0) AS n_rules, coalesce(on_lists, '') AS lists, coalesce(block AND NOT allow, false) AS blocked
FROM c LEFT JOIN found USING (page_id)
"""}
