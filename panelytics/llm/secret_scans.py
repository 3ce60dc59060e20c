"""Secrets in texts, told apart by how widely each value is copied. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics.llm.storage import stored


class Kind(NamedTuple):
    """A pattern; ``group`` is the secret itself and has at least ``least`` characters, or the match is dropped.

    ``noise`` matches what differs between copies of one secret; if anything else is left, that is the value counted.
    """

    name: str
    pattern: str
    group: int
    least: int
    noise: str | None = None


# Patterns and least lengths of the base kinds. A run of hex digits or of an access key is matched
# whole, so a least length inside the pattern finds the same matches as dropping short ones later. An assignment
# needs the latter, because a short match still uses up its text.
BASE_KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
# A private key's block. Loops run over single characters only (no groups, which Java's engine recurses on) and stop at
# dashes, so any length matches in linear time. Without an END line the key goes on to the last long run of base64 and the
# line after it; a header without a key is a match of its own.
_PEM_BEGIN = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
_PEM_BETWEEN = r"""\x09-\x0D\x20\\"'>#*|,;"""
_PEM_ENCRYPTED = (
    rf"""(?:[{_PEM_BETWEEN}nrt]*Proc-Type:\x20*[0-9],ENCRYPTED[{_PEM_BETWEEN}nrt]*DEK-Info:\x20*[A-Za-z0-9-]+,[0-9A-Fa-f]+)?"""
)
PEM = (
    rf"{_PEM_BEGIN}(?:{_PEM_ENCRYPTED}[A-Za-z0-9+/={_PEM_BETWEEN}.:]*-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
    rf"|{_PEM_ENCRYPTED}[A-Za-z0-9+/={_PEM_BETWEEN}]*[A-Za-z0-9+/]{{16,}}={{0,2}}(?:(?:\r?\n|\\n)[\x20\x09]*[A-Za-z0-9+/]+={{0,2}})?)?"
)
PEM_NOISE = (
    r"-----(?:BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----|Proc-Type:\x20*[0-9],ENCRYPTED|DEK-Info:\x20*[A-Za-z0-9-]+,[0-9A-Fa-f]+"
    r"""|\\[nrt]|["'][\s+.]*["']|[^A-Za-z0-9+/=]"""
)
#: Formats of issued credentials that the base kinds miss or cut.
FURTHER_KINDS = (
    Kind(
        "issued",
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
        r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}|sk_live_[0-9A-Za-z]{16,}",
        0,
        20,
    ),
    Kind("pem", PEM, 0, 20, PEM_NOISE),
)
KINDS = BASE_KINDS + FURTHER_KINDS

#: A value is a copied example if this many owners hold it, or if two owners do in so many repositories together. A value
#: of one owner is live in however many repositories it stands.
WIDELY_COPIED, MANY_REPOSITORIES = 3, 20

#: Values folded one after another before the next block starts, and code points of a block that texts are cut from.
_BLOCK, _CUT = 256, 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often lambdas in ``use`` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each of ``values`` the fold of those before it, from 0, and that of all at the end.

    An array only grows by copying it, so values are folded in blocks, then the blocks: work grows with the number of
    values, not with its square.
    """

    def folds(part: Column) -> Column:
        return F.aggregate(
            part, F.array(F.lit(0)), lambda so_far, x: F.concat(so_far, F.array(fold(F.element_at(so_far, -1), x)))
        )

    def joined(blocks: Column) -> Column:
        carried = folds(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return _let(
            carried,
            lambda c: F.concat(
                F.flatten(
                    F.zip_with(
                        blocks,
                        F.slice(c, 1, F.size(blocks)),
                        lambda b, so_far: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: fold(so_far, x)),
                    )
                ),
                F.array(F.element_at(c, -1)),
            ),
        )

    def in_blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(_BLOCK))
        return _let(F.transform(starts, lambda at: folds(F.slice(v, at, _BLOCK))), joined)

    return _let(values, in_blocks)


def _found(text: Column, kind: Kind, order: int) -> Column:
    """Spans of one kind. Positions are added up from the pieces between matches, in code points."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else whole
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), secret.alias("secret"))

    def spans(found: Column) -> Column:
        ends = _before(F.transform(found, lambda part: part["gap"] + part["size"]), lambda x, y: x + y)
        placed = F.arrays_zip(found.alias("part"), F.slice(ends, 2, F.size(found)).alias("end"))
        return F.transform(F.filter(placed, lambda p: F.length(p["part"]["secret"]) >= kind.least), span)

    def span(placed: Column) -> Column:
        value, end = placed["part"]["secret"], placed["end"]
        if kind.noise:
            bare = F.regexp_replace(value, kind.noise, "")
            value = F.when(bare != "", bare).otherwise(value)
        start = end - placed["part"]["size"]
        return F.struct(
            start.alias("start"), F.lit(order).alias("kind_no"), end.alias("end"), F.sha2(value, 256).alias("value")
        )

    # the last gap is that behind all matches
    matches = _let(parts, lambda all_parts: spans(F.slice(all_parts, 1, F.size(all_parts) - 1)))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,kind_no:int,end:int,value:string>>")
    return F.when(text.rlike(kind.pattern), matches).otherwise(none)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind_no, end, value) by start, then kind; ``value`` hashes the secret.

    Positions count code points, the end is exclusive. Matches of one kind never overlap; those of two kinds may.
    Null or empty text has no spans.
    """
    texts = F.coalesce(F.col(text), F.lit(""))
    found = [f"_spans_{kind.name}" for kind in KINDS]
    out = docs.select("*", *(_found(texts, kind, i).alias(found[i]) for i, kind in enumerate(KINDS)))
    return out.withColumn("spans", F.array_sort(F.concat(*found))).drop(*found)


def ownership(found: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """For each secret value: in how many repositories and with how many owners it occurs.

    ``found`` has ``spans``, the owner and the repository. A null owner or repository counts as one of its own kind.
    Copies are folded before each shuffle, so that a value with a third of all rows is a few rows per task.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(alias) for c, alias in ((owner, "o"), (repository, "r"))]
    values = found.select(F.explode("spans.value").alias("value"), *named)
    each = values.distinct().groupBy("value", "o").agg(F.count("*").alias("r"))
    return each.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"))


def _is_copied(widely: int, many: int) -> Column:
    """Whether a row of ``ownership`` is a copied example."""
    return (F.col("n_owners") >= widely) | (F.col("n_owners") >= 2) & (F.col("n_repositories") >= many)


def classify(
    docs: DataFrame,
    owner: str = "source",
    repository: str = "doc_id",
    widely: int = WIDELY_COPIED,
    many: int = MANY_REPOSITORIES,
) -> DataFrame:
    """One row per row of ``docs``: its spans, each with ``n_owners``, ``n_repositories`` and ``live``.

    A value with ``widely`` or more owners, or with two or more in ``many`` repositories, is a copied example; all other
    values are live. Texts are scanned once. Rows with equal ids stay apart. The text itself isn't returned.
    """
    found = stored(scan(docs.select(*dict.fromkeys(["doc_id", "text", owner, repository]))).drop("text"))
    found = found.withColumn("_row", F.monotonically_increasing_id())
    some = found.where(F.size("spans") > 0)
    # stored, so that the join's inputs are bare shuffles, of which Spark splits a value that a third of the rows hold
    owners = stored(ownership(some, owner, repository).withColumn("copied", _is_copied(widely, many)))
    marked = (
        some.select("_row", F.explode("spans").alias("s"))
        .select("_row", "s.*")
        .join(owners, "value")
        .groupBy("_row")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("start", "kind_no", "end", "value", "n_owners", "n_repositories", (~F.col("copied")).alias("live"))
                )
            ).alias("_marked")
        )
    )
    kind = dict(marked.dtypes)["_marked"]
    return found.join(marked, "_row", "left").select(
        *(c for c in found.columns if c not in ("_row", "spans")),
        F.coalesce("_marked", F.from_json(F.lit("[]"), kind)).alias("spans"),
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(kind.name) for kind in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ","
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans, and how many are live or copied examples."""
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind_no"] == i)).cast("long")
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return classify(docs).select(
        "doc_id",
        *(count(i).alias(f"n_{kind.name}") for i, kind in enumerate(BASE_KINDS)),
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind_no"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        live.alias("n_live"),
        (F.size("spans") - live).alias("n_example"),
    )


def _with_marks(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each run of overlapping ``spans``. Spans are sorted by start.

    What lies between is cut from blocks of the text, since a position is found by walking there from the beginning.
    """

    def between(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _CUT).cast("int")
        held = F.slice(blocks, first + 1, F.floor(end / _CUT).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), start - first * _CUT + 1, end - start)

    def pieces(blocks: Column, reach: Column) -> Column:
        runs = F.filter(
            F.arrays_zip(spans.alias("span"), F.slice(reach, 1, F.size(spans)).alias("reach")),
            lambda run: run["span"]["start"] >= run["reach"],
        )
        cut = F.transform(runs, lambda run: between(blocks, run["reach"], run["span"]["start"]))
        return F.concat(cut, F.array(between(blocks, F.element_at(reach, -1), F.length(text))))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))
    reach = _before(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    return F.array_join(_let(blocks, lambda b: _let(reach, lambda r: pieces(b, r))), mark)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each live secret replaced by ``mark`` in ``text``, overlapping spans by one; examples stay.

    ``n_chars``, if there, is counted anew for changed texts. All rows and columns stay.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    found = stored(scan(docs.select("doc_id", "text", "source", whole))).withColumn("_row", F.monotonically_increasing_id())
    some = found.where(F.size("spans") > 0)
    owners = stored(ownership(some).where(~_is_copied(WIDELY_COPIED, MANY_REPOSITORIES)).select("value"))
    live = (
        some.select("_row", F.explode("spans").alias("s"))
        .select("_row", "s.start", "s.end", "s.value")
        .join(owners, "value", "left_semi")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_live"))
    )
    new_text = F.when(F.col("_live").isNotNull(), _with_marks(F.col("text"), F.col("_live"), mark))
    out = found.join(live, "_row", "left").withColumn("_new", new_text)
    new = {"text": F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_new").isNull(), F.col("whole.n_chars")).otherwise(F.length("_new")).cast(kind)
    return out.select(*(new.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns))
