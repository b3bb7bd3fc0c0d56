r"""Secret scanning with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed patterns: kind, pattern, shortest kept value, group of the value.
BASE_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
]
#: A private key from its head to its END line or, where that is missing, to the end of the lines of base64 that
#: follow; the head alone without either. No unbounded group is repeated without being possessive, so no text
#: takes more stack than another, and heads and bodies are read once, so the time is in proportion to the text.
_HEAD, _END = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
_KEY_BODY = rf"""(?:[^-]*+(?:-[^-]++){{0,16}}+{_END}|(?:(?:\\[nr]|[\s"',])*+[A-Za-z0-9+/=]{{16,}}+)++(?:\s*+[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?![^\s"',]))?+)?+"""
#: What is no part of a key's value: its head and END line, white space (also as written in strings) and quotes.
_KEY_FRAME = r"""-----[A-Z ]+-----|\\[nrt]|[\s"',]"""
#: Further kinds of this method: signed web tokens (from the start of a run of their characters) and private keys.
MORE_KINDS = [
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 26, 0),
    ("pem", _HEAD + _KEY_BODY, 27, 0),
]
_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _running_sums(lengths: Column) -> Column:
    """Prefix sums of an array by octupling strides: after round p an element is the sum of the 8^(p+1) up to it.

    An array of n takes n log n steps and no longer copies for each element; 10 rounds are enough for any array.
    """
    for p in range(10):
        stride = 8**p
        add = lambda a: F.transform(a, lambda x, i: sum((F.coalesce(F.get(a, i - j * stride), F.lit(0)) for j in range(1, 8)), x))  # noqa: B023, E731
        once = F.transform(F.array(lengths), lambda a: F.when(F.size(a) > stride, add(a)).otherwise(a))  # noqa: B023
        lengths = F.get(once, F.lit(0))
    return lengths


def _cut(text: Column, pattern: str, group: int) -> Column:
    """A text cut at its leftmost matches: the pieces between them, the matches and their values."""
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), value.alias("value"))
    none = F.array().cast("array<string>")
    return F.when(F.rlike(text, F.lit(pattern)), cut).otherwise(F.struct(none.alias("gaps"), none.alias("whole"), none.alias("value")))


def _spans(text: Column, kinds: list[tuple]) -> Column:
    """Array of (start, rank, kind, end, value) of the leftmost matches of each kind with a value of its least length.

    The pieces between matches and the matches themselves alternate, so running sums of
    their lengths give the positions in code points.
    """
    cuts = F.array(*(_cut(text, pattern, group) for _, pattern, _, group in kinds))
    names, least = (F.array(*(F.lit(kind[k]) for kind in kinds)) for k in (0, 2))
    sized = F.transform(
        cuts,
        lambda s: F.struct(
            s["whole"].alias("whole"),
            s["value"].alias("value"),
            _running_sums(F.transform(s["whole"], lambda w, i: F.length(w) + F.length(F.get(s["gaps"], i)))).alias("ends"),
        ),
    )

    def of_kind(s: Column, rank: Column) -> Column:
        one = lambda w, i: F.struct(
            (F.get(s["ends"], i) - F.length(w)).alias("start"), rank.alias("rank"), F.get(names, rank).alias("kind"), F.get(s["ends"], i).alias("end"), F.get(s["value"], i).alias("value")
        )
        return F.filter(F.transform(s["whole"], one), lambda x: F.length(x["value"]) >= F.get(least, rank))

    return F.flatten(F.transform(sized, of_kind)).cast(f"array<{_SPAN}>")


def _hashed(span: Column) -> Column:
    """SHA-256 of a span's value; of a private key's body alone, so that equal heads don't make keys equal."""
    body = F.regexp_replace(span["value"], F.lit(_KEY_FRAME), F.lit(""))
    return F.sha2(F.when((span["kind"] == "pem") & (body != ""), body).otherwise(span["value"]), 256)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, wide_owners: int = 3, repository: str = "source", owner: str = "owner") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_repositories for every row.

    Spans are kind:start:end in code points, by start and then kind; base kinds as given by
    the patterns above, and the spans of MORE_KINDS in `spans` only. Each candidate value is
    hashed, and its distinct repositories and owners are counted over the whole corpus (first per
    repository and owner, so a hot value shuffles one row per task and repository). A value that
    `wide_owners` owners or more hold is a widely copied example, one that fewer hold is
    owner-specific and looks live, in however many repositories: n_example and n_live count a
    document's spans of each sort, n_repositories is the largest number of repositories that hold
    one of its values (0 without any). A private key's value is its body; a head without any body is
    its own value. Where there is no column `owner`, a repository is its own owner.

    Null and empty texts: no spans and the hash of the empty string. Null repository or owner: one of
    its own. Rows that share a doc_id and repeated rows stay separate. Very long texts and texts of
    many matches take time in proportion to their length (times the logarithm of the matches). Ties of
    start go by kind as listed. Other columns are ignored, whatever their names. Empty input: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = [*BASE_KINDS, *MORE_KINDS]
    spans = _spans(text, kinds)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0")) if c in docs.columns else F.lit("\0")
    held = named(repository)
    found = docs.select("doc_id", held.alias("repository"), (named(owner) if owner in docs.columns else held).alias("owner"), F.array_sort(spans).alias("all"))
    found = stored(found.withColumn("row_id", F.monotonically_increasing_id()))
    candidates = found.filter(F.size("all") > 0).select("row_id", "repository", "owner", F.explode("all").alias("s")).select("row_id", "repository", "owner", _hashed(F.col("s")).alias("key"))
    # stored, so that the join below is between two plain shuffles and Spark can split the rows of a widely copied value
    once = candidates.groupBy("key", "owner", "repository").agg(F.lit(1).alias("one"))
    holders = stored(once.groupBy("key").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")))
    judged = (
        candidates.join(holders, "key")
        .groupBy("row_id")
        .agg(
            F.count_if(F.col("owners") < wide_owners).alias("n_live"),
            F.count_if(F.col("owners") >= wide_owners).alias("n_example"),
            F.max("repositories").alias("n_repositories"),
        )
    )
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("all", lambda s: s["rank"] < len(BASE_KINDS))
    return found.join(judged, "row_id", "left").select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind, *_ in BASE_KINDS),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "n_repositories")),
    )


#: The kinds as DuckDB's expressions have them: either case spelled out, no possessive repeats, which change nothing here. What looks
#: behind or ahead takes a character more, in a group of its own that is cut off again: kind, pattern, shortest value, groups of the value
#: (0: the match), of what is too much before it and after it (0: nothing).
_SQL_SPACE = r"[ \t\n\x0B\f\r]"
_SQL_KINDS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, 0, 0),
    ("access", "AKIA[A-Z0-9]+", 16, 0, 0, 0),
    ("hex", "[0-9a-f]{32,}", 32, 0, 0, 0),
    ("jwt", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 26, 0, 1, 0),
    ("pem", rf"""{_HEAD}(?:[^-]*(?:-[^-]+){{0,16}}{_END}|(?:(?:\\[nr]|[ \t\n\x0B\f\r"',])*[A-Za-z0-9+/=]{{16,}})+(?:{_SQL_SPACE}*[A-Za-z0-9+/]{{1,15}}={{0,2}}([ \t\n\x0B\f\r"',]|$))?)?""", 27, 0, 0, 1),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH kinds AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_quoted(k[0])}, {k[2]})" for i, k in enumerate(_SQL_KINDS))}) v(rank, kind, least)),
d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text FROM documents),
cut AS (
  {" UNION ALL ".join(f"SELECT row_id, {i} AS rank, {', '.join(f'regexp_extract_all(text, {_quoted(p)}, {g}) AS {c}' for c, g in (('m', 0), ('v', value), ('early', before), ('late', after)))}, {before} AS before, {after} AS after, string_split_regex(text, {_quoted(p)}) AS gaps FROM d WHERE regexp_matches(text, {_quoted(p)})" for i, (_, p, _, value, before, after) in enumerate(_SQL_KINDS))}
), flat AS (
  SELECT row_id, rank, before, after, unnest(m) AS m, unnest(v) AS v, unnest(early) AS early, unnest(late) AS late, unnest(gaps[:len(m)]) AS gap, unnest(range(len(m))) AS i FROM cut
), sized AS (
  SELECT *, CASE WHEN before > 0 THEN coalesce(length(early), 0) ELSE 0 END AS n_early, CASE WHEN after > 0 THEN coalesce(length(late), 0) ELSE 0 END AS n_late FROM flat
), placed AS (
  SELECT row_id, rank, CASE WHEN before + after = 0 THEN v ELSE substr(m, n_early + 1, length(m) - n_early - n_late) END AS v, length(m) - n_early - n_late AS size,
    sum(length(gap) + length(m)) OVER (PARTITION BY row_id, rank ORDER BY i) - n_late AS stop FROM sized
), bodies AS (
  SELECT *, CASE WHEN rank = {len(_SQL_KINDS) - 1} THEN regexp_replace(v, {_quoted(_KEY_FRAME.replace(chr(92) + "s", " " + chr(92) + "t" + chr(92) + "n" + chr(92) + "x0B" + chr(92) + "f" + chr(92) + "r"))}, '', 'g') ELSE '' END AS body FROM placed
), spans AS (
  SELECT row_id, rank, kind, (stop - size)::BIGINT AS start, stop::BIGINT AS stop, sha256(CASE WHEN body <> '' THEN body ELSE v END) AS key FROM bodies JOIN kinds USING (rank) WHERE length(v) >= least
), holders AS (SELECT key, count(DISTINCT source) AS n FROM spans JOIN d USING (row_id) GROUP BY key),
per AS (
  SELECT row_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (WHERE n < 3) AS n_live, count(*) FILTER (WHERE n >= 3) AS n_example, max(n) AS n_repositories
  FROM spans JOIN holders USING (key) GROUP BY row_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example, coalesce(n_repositories, 0)::BIGINT AS n_repositories
FROM d LEFT JOIN per USING (row_id)
"""
