"""Operator 5: secret scan with corpus-wide ownership frequency (native SQL).

Candidates are found by patterns, then judged by who holds them: the value of
each candidate is aggregated over the corpus to its number of distinct owners
and distinct repositories. A value held by at most ``max_owners`` owners is
owner-specific and looks live; one held by more is a widely copied example.

Kinds of span, in this order:

* ``assign``, ``access``, ``hex``: the base patterns, leftmost and not
  overlapping per kind; always reported, and counted as live or copied;
* ``owned``: an opaque string without a keyword (24+ characters of
  ``[A-Za-z0-9+/_-]`` with lower case, upper case and digits) outside every
  base span, reported only when its value is owner-specific. This is what the
  ownership frequency adds: a bare string that many owners share is an example
  or an identifier, one that a single owner holds is a credential.

Offsets come from one extraction per kind: every match is taken together with
the text since the previous match (``\\G`` pins it there, so a search is
linear), and the lengths add up to code-point positions. They are added up in
chunks of ``CHUNK`` matches: first the chunks' totals, then within a chunk; so
a text of 100,000 matches takes seconds. Which opaque strings overlap a base
span is looked up by the same chunks' extents.

Everything is DataFrame functions. Only the candidates leave the scan; they
are counted with partial aggregation and joined back by a hash of the value,
where a value that a third of the documents hold is a skewed key that the
adaptive join splits.

Cases: a null text counts as empty; a text without candidates gives zero
counts and empty spans; a null owner or repository is no owner; a repeated row
is reported twice; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.staging import stage, table, text_of

# The base patterns, kind -> (pattern, group whose length counts,
# least length). The length is part of a pattern where that cannot change the
# other matches: runs of one character class are maximal either way.
ASSIGN = (r"(?:(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+))")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
MAX_OWNERS = 1
CHUNK = 256


def _matches(text: Column, pattern: str) -> Column:
    """Each match with the text between it and the match before."""
    return F.regexp_extract_all(text, F.lit(r"\G(?s:.*?)(?:" + pattern + ")"), F.lit(0))


def _chunks(items: Column) -> Column:
    """The numbers of an array's chunks; one for an empty array."""
    return F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0)))


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def _totals(lengths: Column) -> Column:
    """Per chunk the sum of all lengths before it."""
    return F.transform(_chunks(lengths), lambda c: _sum(F.slice(lengths, 1, c * CHUNK)))


def _spans(kind: str, rank: int, pieces: Column, lengths: Column, before: Column, pattern: str, group: int,
           least: int) -> Column:
    """Structs ``start, rank, kind, end, value`` of the matches long enough,
    from columns that hold the pieces, their lengths and the chunks' totals."""
    def end(i: Column) -> Column:
        c = F.floor(i / CHUNK).cast("int")
        return F.element_at(before, c + 1) + _sum(F.slice(lengths, c * CHUNK + 1, i - c * CHUNK + 1))

    def span(p: Column, i: Column) -> Column:
        return F.struct(
            (end(i) - F.length(F.regexp_extract(p, pattern, 0))).alias("start"),
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            end(i).alias("end"), F.regexp_extract(p, pattern, group).alias("value"))

    return F.filter(F.transform(pieces, span), lambda s: F.length(s["value"]) >= least)


def _overlaps(s: Column, base: Column, extents: Column) -> Column:
    """Whether a span overlaps one of ``base``; ``extents``: its chunks' least start and largest end."""
    def in_chunk(c: Column) -> Column:
        e = F.element_at(extents, c + 1)
        return (e["lo"] < s["end"]) & (s["start"] < e["hi"]) & F.exists(
            F.slice(base, c * CHUNK + 1, CHUNK), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return F.exists(_chunks(base), in_chunk)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 owner_col: str = "source", repo_col: str = "doc_id",
                 max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per input row: counts per base kind, all spans with their
    start, end and kind, and how many are live or copied."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(owner_col).cast("string").alias("_owner"),
                     F.col(repo_col).cast("string").alias("_repo"), text_of(text_col).alias("_text"))
    # Each step is a select of its own: what the next one's lambdas read is a
    # column by then and not worked out anew for every match.
    kinds = {**KINDS, "owned": (OPAQUE, 0, 24)}
    own = ["_id", "_owner", "_repo"]
    cols = lambda name: [F.col(f"_{k}_{name}") for k in kinds]
    pieces = rows.select(*own, *[_matches(F.col("_text"), p).alias(f"_{k}_pieces") for k, (p, _, _) in kinds.items()])
    pieces = pieces.select("*", *[F.transform(F.col(f"_{k}_pieces"), lambda p: F.length(p)).alias(f"_{k}_lengths")
                                  for k in kinds])
    pieces = pieces.select("*", *[_totals(c).alias(f"_{k}_before") for k, c in zip(kinds, cols("lengths"), strict=True)])
    found = pieces.select(*own, *[_spans(k, r, F.col(f"_{k}_pieces"), F.col(f"_{k}_lengths"), F.col(f"_{k}_before"),
                                         *kinds[k]).alias(f"_{k}") for r, k in enumerate(kinds)])
    found = found.select(*own, *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                         F.concat(*[F.col(f"_{k}") for k in KINDS]).alias("_base"), F.col("_owned").alias("_bare"))
    found = found.select("*", F.transform(_chunks(F.col("_base")), lambda c: F.struct(
        F.array_min(F.transform(F.slice("_base", c * CHUNK + 1, CHUNK), lambda s: s["start"])).alias("lo"),
        F.array_max(F.transform(F.slice("_base", c * CHUNK + 1, CHUNK), lambda s: s["end"])).alias("hi"))).alias("_extents"))
    opaque = F.filter("_bare", lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
                      & s["value"].rlike("[0-9]")
                      & ~F.coalesce(_overlaps(s, F.col("_base"), F.col("_extents")), F.lit(False)))
    hashed = lambda a: F.transform(a, lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"),
        s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    docs = stage(
        found.withColumn("_bare", opaque)
        .select(F.monotonically_increasing_id().alias("_uid"), *own, *[f"n_{k}" for k in KINDS],
                hashed(F.col("_base")).alias("_base"), hashed(F.col("_bare")).alias("_bare")),
        "secrets")
    cands = docs.select("_uid", "_owner", "_repo", F.explode(F.concat("_base", "_bare")).alias("_s"))
    held = cands.groupBy(F.col("_s.hash").alias("_hash")).agg(
        F.count_distinct("_owner").alias("_owners"), F.count_distinct("_repo").alias("_repos"))
    judged = cands.withColumn("_hash", F.col("_s.hash")).join(held, "_hash")
    live = F.col("_owners") <= max_owners
    span = F.struct("_s.start", "_s.rank", "_s.kind", "_s.end")
    per_doc = judged.groupBy("_uid").agg(
        F.collect_list(F.when(live & (F.col("_s.kind") == "owned"), span)).alias("_owned"),
        F.count_if(live).alias("_live"), F.count_if(~live).alias("_copied"),
        F.max("_repos").alias("_most"))
    plain = F.transform("_base", lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return docs.join(per_doc, "_uid", "left").select(
        F.col("_id").alias(id_col), *[f"n_{k}" for k in KINDS], plain.alias("base"),
        F.when(F.col("_owned").isNull(), plain).otherwise(F.concat(plain, F.col("_owned"))).alias("all_spans"),
        zero("_live").alias("n_live"), zero("_copied").alias("n_copied"),
        zero("_most").alias("max_repositories"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan_secrets(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_assign", "n_access", "n_hex",
                    F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
                    _said(F.col("all_spans")).alias("spans"),
                    "n_live", "n_copied", "max_repositories")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT rid, doc_id, source, 0 AS rank, 'assign' AS kind, 6 AS least,
         unnest(regexp_extract_all(t, '(?s)(.*?)((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 1)) AS gap,
         unnest(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 1)) AS hit,
         unnest(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2)) AS value,
         generate_subscripts(regexp_extract_all(t, '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 1), 1) AS i
  FROM d
  UNION ALL
  SELECT rid, doc_id, source, 1, 'access', 20,
         unnest(regexp_extract_all(t, '(?s)(.*?)(AKIA[A-Z0-9]+)', 1)),
         unnest(regexp_extract_all(t, '(AKIA[A-Z0-9]+)', 1)), unnest(regexp_extract_all(t, '(AKIA[A-Z0-9]+)', 1)),
         generate_subscripts(regexp_extract_all(t, '(AKIA[A-Z0-9]+)', 1), 1)
  FROM d
  UNION ALL
  SELECT rid, doc_id, source, 2, 'hex', 24,
         unnest(regexp_extract_all(t, '(?s)(.*?)([0-9a-f]+)', 1)),
         unnest(regexp_extract_all(t, '([0-9a-f]+)', 1)), unnest(regexp_extract_all(t, '([0-9a-f]+)', 1)),
         generate_subscripts(regexp_extract_all(t, '([0-9a-f]+)', 1), 1)
  FROM d
  UNION ALL
  SELECT rid, doc_id, source, 3, 'owned', 24,
         unnest(regexp_extract_all(t, '(?s)(.*?)([A-Za-z0-9+/_-]+)', 1)),
         unnest(regexp_extract_all(t, '([A-Za-z0-9+/_-]+)', 1)), unnest(regexp_extract_all(t, '([A-Za-z0-9+/_-]+)', 1)),
         generate_subscripts(regexp_extract_all(t, '([A-Za-z0-9+/_-]+)', 1), 1)
  FROM d),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, rank ORDER BY i) AS e FROM m),
s AS (SELECT rid, doc_id, source, rank, kind, (e - length(hit))::BIGINT AS st, e::BIGINT AS en, value
      FROM placed WHERE length(value) >= least),
cand AS (
  SELECT * FROM s WHERE rank < 3
  UNION ALL
  SELECT o.* FROM s o WHERE o.rank = 3 AND regexp_matches(o.value, '[a-z]') AND regexp_matches(o.value, '[A-Z]')
    AND regexp_matches(o.value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM s b WHERE b.rid = o.rid AND b.rank < 3 AND b.st < o.en AND o.st < b.en)),
held AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM cand GROUP BY value),
j AS (SELECT c.*, h.owners, h.repos FROM cand c JOIN held h USING (value)),
per AS (
  SELECT rid,
    count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
    count(*) FILTER (rank = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank) FILTER (rank < 3), '') AS base,
    coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, rank)
             FILTER (rank < 3 OR owners <= 1), '') AS spans,
    count(*) FILTER (owners <= 1) AS n_live, count(*) FILTER (owners > 1) AS n_copied, max(repos) AS most
  FROM j GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most, 0) AS max_repositories
FROM d LEFT JOIN per USING (rid)
"""
