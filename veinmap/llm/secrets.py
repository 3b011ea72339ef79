"""Secret scan with multipart credential linking, in DataFrame operations only.

Each kind of part has a pattern. A text split at a pattern's matches gives the
gaps between them, so running sums over gap and match lengths give the matches'
positions in code points. All parts of a text, a handful of numbers each, are
dealt by row; the text itself is not.

Parts play roles: identifiers, secrets, endpoints. Strong kinds are reported as
they are. A weak part that overlaps a strong one says nothing new, and a weak
secret that overlaps an endpoint is a piece of its path; neither counts as a part.
The other weak parts are reported only where complementary ones stand apart from
them, with at most scope characters between the end of one and the start of the
other:

- a weak identifier needs a secret,
- a weak secret needs an identifier,
- an endpoint needs both.

Both questions are interval joins of a text's parts with themselves. Each part
gives two marks, at its start and at its end, and range frames over the marks
answer them: parts that overlap [a, b) are those that start before b less those
that end by a, and a complement after a part has a start mark within scope of its
end. The parts of one text, a few numbers each, are sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUE = r"[A-Za-z0-9+/_.=-]"

#: Kinds in the order of their rank: name, pattern, role, strong.
KINDS = (
    ("assign", rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE}+)""", "secret", True),
    ("access", r"(AKIA[A-Z0-9]{16,})", "identifier", True),  # AKIA[A-Z0-9]+ of 20 characters or more
    ("hex", r"([0-9a-f]{24,})", "secret", True),
    ("weak_identifier", rf"""(?i:access_?key_?id|client_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?({VALUE}+)""", "identifier", False),
    ("weak_secret", r"([A-Za-z0-9+/_-]{32,}={0,2})", "secret", False),
    ("endpoint", r"""((?i:https?|ftps?|postgresql|postgres|mysql|redis|amqps?|mongodb)://[^\s"'<>]+)""", "endpoint", False),
)
#: Characters that the value of a labelled part has at least.
LEAST_VALUE = {"assign": 6, "weak_identifier": 3}
SCOPE = 400


def _parts(text: Column, rank: int, pattern: str, least: int) -> tuple[Column, Column]:
    """The matches of one kind, and from these an array of (rank, i, gap, width, good)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def described(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        good = (lambda m: F.length(F.regexp_extract(m, pattern, 1)) >= least) if least > 1 else (lambda m: F.lit(True))
        each = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("width"), good(m).alias("good")))
        numbered = F.transform(each, lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), x["gap"].alias("gap"), x["width"].alias("width"), x["good"].alias("good")))
        return F.when(F.size(found) > 0, numbered).otherwise(F.array().cast("array<struct<rank:int,i:int,gap:int,width:int,good:boolean>>"))

    return matches, described


def parts(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row_id, doc_id, rank, start, stop, reported): all parts of all texts, and a row without a part for texts that have none.

    row_id tells rows of equal doc_id apart.
    """
    base = docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    columns, described = [], []
    for rank, (name, pattern, _, _) in enumerate(KINDS):
        matches, describe = _parts(F.col("text"), rank, pattern, LEAST_VALUE.get(name, 1))
        columns.append(matches.alias(f"m{rank}"))
        described.append(describe(F.col(f"m{rank}")))
    scanned = base.select("*", *columns).select("row_id", "doc_id", F.concat(*described).alias("parts"))
    rows = scanned.select("row_id", "doc_id", F.explode_outer("parts").alias("p")).select("row_id", "doc_id", "p.*").repartition("row_id")

    along = Window.partitionBy("row_id", "rank").orderBy("i")
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.col("width")).over(along)).withColumn("start", F.col("stop") - F.col("width"))
    # Failing matches took part in the positions and go now; the row of a text without parts stays.
    placed = placed.filter(F.col("good").isNull() | F.col("good") | (F.col("i") == 0)).withColumn("good", F.coalesce("good", F.lit(False)))
    strong, marks = _among(lambda x: x[3]), Window.partitionBy("row_id").orderBy("at")

    def overlapping(kind: Column) -> Column:
        """Parts of a kind that overlap: a start mark counts, negatively, those that end by it, an end mark those that start before it."""
        ended = F.count_if(~F.col("at_start") & kind).over(marks.rangeBetween(Window.unboundedPreceding, 0))
        begun = F.count_if(F.col("at_start") & kind).over(marks.rangeBetween(Window.unboundedPreceding, -1))
        return F.when(F.col("at_start"), -ended).otherwise(begun)

    covered = _marks(placed).withColumns({"strong_over": overlapping(F.col("good") & strong), "endpoint_over": overlapping(F.col("good") & _among(lambda x: x[0] == "endpoint"))})
    parts_ = covered.groupBy("row_id", "rank", "i").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("stop").alias("stop"), F.first("good").alias("good"), F.sum("strong_over").alias("strong_over"), F.sum("endpoint_over").alias("endpoint_over"))
    inside = (F.col("strong_over") > 0) | _among(lambda x: x[0] == "weak_secret") & (F.col("endpoint_over") > 0)
    valid = parts_.withColumn("good", F.col("good") & (strong | ~inside))

    def near(role: str) -> Column:
        """Whether a part of a role ends within scope before a start mark, or starts within scope after an end mark."""
        is_role = F.col("good") & _among(lambda x: x[2] == role)
        before = F.max(~F.col("at_start") & is_role).over(marks.rangeBetween(-scope, 0))
        after = F.max(F.col("at_start") & is_role).over(marks.rangeBetween(0, scope))
        return F.when(F.col("at_start"), before).otherwise(after)

    linked = _marks(valid).withColumns({"near_identifier": near("identifier"), "near_secret": near("secret")})
    found = linked.groupBy("row_id", "rank", "i").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.first("stop").alias("stop"), F.first("good").alias("good"), F.max("near_identifier").alias("near_identifier"), F.max("near_secret").alias("near_secret"))
    complement = F.when(_among(lambda x: x[2] == "identifier"), F.col("near_secret")).when(_among(lambda x: x[2] == "secret"), F.col("near_identifier")).otherwise(F.col("near_identifier") & F.col("near_secret"))
    return found.select("row_id", "doc_id", "rank", "start", "stop", (F.col("good") & (strong | complement)).alias("reported"))


def _among(kinds) -> Column:
    """Whether a part is of one of the kinds that a condition picks."""
    return F.col("rank").isin(*[k for k, x in enumerate(KINDS) if kinds(x)])


def _marks(rows: DataFrame) -> DataFrame:
    """Each part twice: at its start and at its end."""
    return rows.select("row_id", "doc_id", "rank", "i", "start", "stop", "good", F.explode(F.array(F.lit(True), F.lit(False))).alias("at_start")).withColumn("at", F.when(F.col("at_start"), F.col("start")).otherwise(F.col("stop")))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, counts of the strong kinds, base_sha256 and spans.

    A null or empty text has no spans (the digest is that of the empty string);
    rows of equal or null doc_id are kept apart; an empty table gives an empty
    result; other columns of docs are not read.
    """
    names = F.array(*[F.lit(x[0]) for x in KINDS])
    found = parts(docs, scope)
    span = F.when(F.col("reported"), F.struct(F.col("start"), F.col("rank"), F.col("stop")))
    rows = found.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"), *[F.count_if(F.col("reported") & (F.col("rank") == k)).alias(f"n_{x[0]}") for k, x in enumerate(KINDS) if x[3]])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    n_strong = sum(x[3] for x in KINDS)
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.filter("spans", lambda s: s["rank"] < n_strong)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    quoted = [p.replace("'", "''") for _, p, _, _ in KINDS]
    kinds = "\n  UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, unnest(range(len(m))) AS i, unnest(list_transform(m, lambda x: len(x))) AS width, unnest(list_transform(g[1:len(m)], lambda x: len(x))) AS gap, "
        f"unnest(list_transform(m, lambda x: len(regexp_extract(x, '{p}', 1)) >= {LEAST_VALUE.get(KINDS[k][0], 1)})) AS good "
        f"FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d)"
        for k, p in enumerate(quoted)
    )
    of = lambda role: ", ".join(str(k) for k, x in enumerate(KINDS) if x[2] == role)
    name = "[" + ", ".join(f"'{x[0]}'" for x in KINDS) + "]"
    apart = f"a.doc_id = b.doc_id AND (b.start >= a.stop AND b.start - a.stop <= {SCOPE} OR b.stop <= a.start AND a.start - b.stop <= {SCOPE})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS ({kinds}),
q AS (SELECT *, sum(gap + width) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM p),
r AS (SELECT doc_id, rank, CAST(stop - width AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM q WHERE good),
v AS (SELECT * FROM r a WHERE rank < 3 OR NOT EXISTS (FROM r b WHERE a.doc_id = b.doc_id AND b.start < a.stop AND b.stop > a.start AND (b.rank < 3 OR a.rank = 4 AND b.rank = 5))),
s AS (SELECT a.*, EXISTS (FROM v b WHERE {apart} AND b.rank IN ({of("identifier")})) AS ni, EXISTS (FROM v b WHERE {apart} AND b.rank IN ({of("secret")})) AS ns FROM v a),
k AS (SELECT doc_id, rank, start, ({name}[rank + 1] || ':' || start || ':' || stop) AS label FROM s
  WHERE rank < 3 OR CASE WHEN rank IN ({of("identifier")}) THEN ns WHEN rank IN ({of("secret")}) THEN ni ELSE ni AND ns END)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(label, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(label, ',' ORDER BY start, rank) FILTER (rank IS NOT NULL), '') AS spans
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id
"""


ORACLE = _oracle()
