"""URL filters from a path-template tree per host.

A URL's path, with digit runs and long hexadecimal runs generalised, is a branch of its host's tree, down to its
last segment.  From fork to fork, two things happen to the children of each node.  Where many are rare (``MANY`` or
more of fewer than ``RARE`` URLs each), the segment is variable and the rare ones become the wildcard ``*``; so few
URLs can't be tested one by one.  Any other child is judged by its own labels: if they don't differ from the node's as a whole, by a test of
proportions at ``ALIKE`` standard deviations, it is merged into ``*``, else it stays a branch of its own.
Each branch that remains is a template.  Its share of bad labels is smoothed towards that of all labelled URLs
with the weight of ``PRIOR`` URLs, and templates from ``REJECT`` on are rejected with all their URLs.

The rounds work on distinct generalised paths, not on URLs; each is a few aggregations and equi-joins.

Results for odd inputs: the host is compared in lower case, without user and port; query and fragment don't
count, nor do empty segments; a null URL, or one without a scheme and host, has the host ``''`` and is never rejected; a null label says nothing; a template without labels has the overall
share; without any labels nothing is rejected; repeated rows count and are reported each; an empty table gives
an empty result; of equally long paths through a node any says where it forks, all alike; shares that tie with
``REJECT`` are rejected; very long paths are read whole; other columns of the table can have any name, a kept one named like
a column of the result gets an underscore behind its name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.session import cut, kept, table

#: Levels of the SQL's tree; it takes segments from the last of them on as one.
LEVELS = 6
MANY, RARE = 10, 3
ALIKE = 2.0
PRIOR = 5.0
REJECT = 0.5

_SEGMENTS = [f"s{k}" for k in range(1, LEVELS + 1)]


def host_of(url: Column) -> Column:
    rough = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.coalesce(F.regexp_replace(F.regexp_replace(rough, "^.*@", ""), ":[0-9]*$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The generalised path: segments with a slash between each two."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#][\s\S]*$", "")
    path = F.regexp_replace(F.regexp_replace(path, "[0-9a-fA-F-]{16,}", "{x}"), "[0-9]+", "{n}")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")
    return F.coalesce(path, F.lit(""))


def segments_of(url: Column) -> list[Column]:
    """The first ``LEVELS`` segments as the SQL has them, the last with all that follow, ``''`` where there are fewer."""
    parts = F.split(path_of(url), "/", LEVELS)
    return [F.coalesce(F.get(parts, k), F.lit("")).alias(name) for k, name in enumerate(_SEGMENTS)]


def _fork(rest: Column, longest: Column) -> Column:
    """The first place (from 1) where ``rest`` has another segment than ``longest``, null where it is the beginning of it."""
    return F.nullif(F.array_position(F.zip_with(rest, longest, lambda x, y: F.coalesce(x != y, F.lit(False))), True).cast("int"), F.lit(0))


def _joined(node: Column, segments: Column) -> Column:
    return F.concat(node, F.array_join(F.transform(segments, lambda x: F.concat(F.lit("/"), x)), ""))


def templates(paths: DataFrame) -> DataFrame:
    """Rows ``host, path, n, labelled, bad`` with the ``template`` after merging.

    ``node`` is what is settled of a path, ``rest`` what is not.  A round takes every node down to its next fork and
    merges the children there; paths that don't fork any more are done.  So the rounds are as many as the forks
    on one branch, however many segments it has.
    """
    counts = ("n", "labelled", "bad")
    own, node = "own", ["host", "node"]
    rows = cut(paths.select("host", "path", *counts, F.lit("").alias("node"), F.filter(F.split("path", "/"), lambda x: x != "").alias("rest")))
    done = []
    while True:
        longest = rows.groupBy(*node).agg(F.max_by("rest", F.size("rest")).alias("longest"))
        forks = rows.join(longest, node).groupBy(*node).agg(F.min(_fork(F.col("rest"), F.col("longest"))).alias("fork"))
        rows = cut(rows.join(forks, node))
        open_ = F.coalesce(F.size("rest") >= F.col("fork"), F.lit(False))
        done.append(rows.where(~open_).select("host", "path", *counts, _joined(F.col("node"), F.col("rest")).alias("template")))
        rows = rows.where(open_).select("host", "path", *counts, _joined(F.col("node"), F.slice("rest", 1, F.col("fork") - 1)).alias("node"), F.element_at("rest", F.col("fork")).alias(own), F.slice("rest", F.col("fork") + 1, F.size("rest")).alias("rest"))
        if rows.isEmpty():
            break
        child = rows.groupBy(*node, own).agg(*[F.sum(c).alias(c) for c in counts])
        all_ = child.groupBy(*node).agg(F.count("*").alias("kids"), F.count_if(F.col("n") < RARE).alias("rare"), *[F.sum(c).alias(f"all_{c}") for c in ("labelled", "bad")])
        both = child.join(all_, node)
        share = F.when(F.col("all_labelled") > 0, F.col("all_bad") / F.col("all_labelled")).otherwise(F.lit(0.0))
        off = F.col("bad") - F.col("labelled") * share
        alike = off * off <= F.lit(ALIKE * ALIKE) * F.col("labelled") * share * (1 - share)
        wild = (F.col("rare") >= MANY) & (F.col("n") < RARE) | (F.col("kids") > 1) & alike
        merged = both.where(wild).select(*node, own, F.lit(True).alias("wild"))
        found = F.concat("node", F.lit("/"), F.when(F.col("wild"), "*").otherwise(F.col(own)))
        rows = cut(rows.join(merged, [*node, own], "left").select("host", "path", *counts, found.alias("node"), "rest"))
    return reduce(DataFrame.unionAll, done).withColumn("template", F.when(F.col("template") == "", "/").otherwise(F.col("template")))


def judge(df: DataFrame, bad: str, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep``, and ``host, template, n_urls, n_labelled, n_bad, bad_share, rejected`` of each row's URL.

    ``bad`` names a column with 1 for bad, 0 for good, null for unlabelled URLs.
    """
    label = F.col(bad).cast("int")
    made = ("host", "template", "n_urls", "n_labelled", "n_bad", "bad_share", "rejected")
    results = df.select(*kept(df, keep, made)).columns
    named = {c: f"__keep{i}" for i, c in enumerate(keep)}
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), label.alias("bad"))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    found = templates(paths)
    totals = found.agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).head()
    overall = totals.b / totals.l if totals.l else 0.0
    per = found.groupBy("host", "template").agg(*[F.sum(c).alias(o) for c, o in (("n", "n_urls"), ("labelled", "n_labelled"), ("bad", "n_bad"))])
    share = (F.col("n_bad") + PRIOR * overall) / (F.col("n_labelled") + PRIOR)
    per = per.withColumn("bad_share", F.round(share, 6)).withColumn("rejected", (F.col("bad_share") >= REJECT) & (F.col("host") != "") & F.lit(bool(totals.l)))
    mapped = cut(found.select("host", "path", "template").join(per, ["host", "template"]))
    out = rows.drop("bad").join(mapped, ["host", "path"])
    return out.select(*[F.col(n).alias(c) for c, n in zip(results, named.values())], *made)


#: Part of a page's URL that names the document it shows; its label is the URL's.
_DOCUMENT = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/[a-z]*/([0-9]{1,18})"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the labels of the documents they show: bad is toxic or of low quality."""
    bad = F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0))
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("shown")).agg(bad.alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"try_cast(regexp_extract(url, '{_DOCUMENT}', 1) as long)").alias("shown"))
    return judge(pages.join(labels, "shown", "left"), "bad")


def _sql() -> str:
    current = [s.replace("s", "t") for s in _SEGMENTS]
    parts = ", ".join(f"split_part(p, '/', {k}) AS s{k}" for k in range(1, LEVELS)) + f", coalesce(array_to_string(string_split(p, '/')[{LEVELS}:], '/'), '') AS s{LEVELS}"
    s, t = ", ".join(_SEGMENTS), ", ".join(current)
    steps = [f"r0 AS (SELECT *, {', '.join(f'{a} AS {b}' for a, b in zip(_SEGMENTS, current))} FROM paths)"]
    for k in range(1, LEVELS + 1):
        before = ", ".join(["host", *current[: k - 1]])
        own = f"t{k}"
        on = " AND ".join(f"r.{c} = w.{c}" for c in ["host", *current[:k]])
        steps.append(f"""c{k} AS (SELECT {before}, {own}, sum(n)::BIGINT AS n, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad FROM r{k - 1} WHERE {own} <> '' GROUP BY {before}, {own}),
v{k} AS (SELECT *, count(*) OVER x AS kids, count(*) FILTER (n < {RARE}) OVER x AS rare,
  CASE WHEN sum(labelled) OVER x > 0 THEN (sum(bad) OVER x)::DOUBLE / (sum(labelled) OVER x)::DOUBLE ELSE 0::DOUBLE END AS share FROM c{k} WINDOW x AS (PARTITION BY {before})),
w{k} AS (SELECT * FROM v{k} WHERE rare >= {MANY} AND n < {RARE} OR kids > 1 AND
  (bad::DOUBLE - labelled::DOUBLE * share) * (bad::DOUBLE - labelled::DOUBLE * share) <= {ALIKE * ALIKE}::DOUBLE * labelled::DOUBLE * share * (1::DOUBLE - share)),
r{k} AS (SELECT r.host, {', '.join('r.' + c for c in _SEGMENTS)}, r.n, r.labelled, r.bad, {', '.join(f"CASE WHEN w.host IS NOT NULL THEN '*' ELSE r.{c} END AS {c}" if c == own else 'r.' + c for c in current)}
  FROM r{k - 1} r LEFT JOIN w{k} w ON {on})""")
    return f"""
WITH lab AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
g AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '') AS host,
  regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '', 's') AS path,
  try_cast(regexp_extract(url, '{_DOCUMENT}', 1) AS BIGINT) AS shown FROM pages),
h AS (SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '[0-9a-fA-F-]{{16,}}', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g') AS p, lab.bad
  FROM g LEFT JOIN lab ON lab.doc_id = g.shown),
u AS (SELECT page_id, coalesce(host, '') AS host, {parts}, bad FROM (SELECT page_id, host, coalesce(p, '') AS p, bad FROM h)),
paths AS (SELECT host, {s}, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0)::BIGINT AS bad FROM u GROUP BY host, {s}),
{', '.join(steps)},
total AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad)::DOUBLE / sum(labelled)::DOUBLE ELSE 0::DOUBLE END AS overall, sum(labelled) > 0 AS has_labels FROM r{LEVELS}),
per AS (SELECT host, {t}, sum(n)::BIGINT AS n_urls, sum(labelled)::BIGINT AS n_labelled, sum(bad)::BIGINT AS n_bad FROM r{LEVELS} GROUP BY host, {t}),
judged AS (SELECT per.*, round((n_bad::DOUBLE + {PRIOR}::DOUBLE * overall) / (n_labelled::DOUBLE + {PRIOR}::DOUBLE), 6) AS bad_share, has_labels FROM per, total)
SELECT u.page_id, u.host, '/' || concat_ws('/', {', '.join(f"nullif(r.{c}, '')" for c in current)}) AS template, n_urls, n_labelled, n_bad, bad_share,
  bad_share >= {REJECT} AND u.host <> '' AND has_labels AS rejected
FROM u JOIN r{LEVELS} r USING (host, {s}) JOIN judged j ON {' AND '.join(f'j.{c} = r.{c}' for c in ['host', *current])}
"""


SQL = _sql()
