"""Personal data in texts, and the words near it that would give it away.

Addresses, card and phone numbers are found by form. Taking one of them out protects nobody if the words around it are
found with it and hardly anywhere else. So the corpus is asked: how much does a word near a protected value say about
it? That is their pointwise mutual information, counted in documents, as a share of the value's own information: 1 for
a word that never occurs without the value, 0 for one that is independent of it. Words above GENERALISED are cut to
their first letter, those above REMOVED go.

Null texts have no spans. Rows with equal or null ids stay apart. A word is a run of letters and of characters
beyond ASCII, its A-Z lower-cased; words inside a value are part of it. What a document without protected values says is
left alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics.llm.batches import byte_table, in_batches, text_bytes, text_chunks, words_of
from panelytics.llm.storage import stored

# The kinds, in the order in which spans with one start are listed, with their signs in sanitised text.
KINDS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": None, "removed": ""}
NAMES = tuple(KINDS)
BASE = 4
#: Words on either side of a value that may disclose it.
WINDOW = 5
#: Different surroundings in which a word stands near a value before their going together counts.
CONTEXTS = 3
#: Shares of a value's information from which on a word near it is generalised, and removed.
GENERALISED, REMOVED = 0.75, 0.9

_LETTERS = byte_table((97, 122), (128, 255))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Where digits, points, blanks and hyphens follow one another; no address or card number reaches beyond.
_FIGURES = re.compile(r"[0-9][0-9.\x20-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """From each @ with a domain back over the name before it, which a plain pattern would try from every letter."""
    free = 0  # where the last address ended
    for found in _DOMAIN.finditer(text):
        start = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < found.start():
            free = found.end()
            yield start, free, text[start:free].lower()


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    for run in _FIGURES.finditer(text):
        # a number is taken up at its first digit only: from a later one it fails or ends where it did
        for found in _IP.finditer(text, run.start(), run.end()):
            parts = found[0].split(".")
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
                yield found.start(), found.end(), found[0]


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int, str]]:
    for run in _FIGURES.finditer(text):
        if run.end() - run.start() >= 12:
            for found in _CARD.finditer(text, run.start(), run.end()):
                digits = found[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    yield found.start(), found.end(), digits


def _phones(text: str) -> Iterator[tuple[int, int, str]]:
    for found in _PHONE.finditer(text):
        digits = "".join(filter(str.isdigit, found[0]))
        if 9 <= len(digits) <= 15:
            yield found.start(), found.end(), digits


_FINDERS = ((_emails, "@"), (_addresses, "."), (_cards, ""), (_phones, "+"))


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of every protected value, by start, then kind; positions are code points."""
    if not text:
        return []
    found = [
        (start, kind, end, value)
        for kind, (finder, sign) in enumerate(_FINDERS)
        if sign in text
        for start, end, value in finder(text)
    ]
    return sorted(found)


def _signed(value: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(value)).astype(np.int64))


def surroundings(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, int, int]]:
    """(entity, term, context, start, end) of each of the WINDOW words on either side of each value.

    ``context`` tells surroundings apart, so that copies of a passage count as one.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    words = words_of(data, np.array([0, len(data)]), _LETTERS)
    point = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte, its code point
    starts, ends = point[words.start], point[words.end - 1] + 1
    free = np.ones(len(starts), bool)
    for start, _, end, _ in spans:
        free[bisect_left(ends, start + 1) : bisect_left(starts, end)] = False
    starts, ends, terms = starts[free], ends[free], words.hash[free].astype(np.int64)
    out = []
    for start, kind, end, value in spans:
        middle, after = bisect_left(ends, start + 1), bisect_left(starts, end)
        near = [*range(max(0, middle - WINDOW), middle), *range(after, min(after + WINDOW, len(starts)))]
        entity, context = _signed(f"{kind}:{value}".encode()), _signed(terms[near].tobytes())
        out += [(entity, int(terms[i]), context, int(starts[i]), int(ends[i])) for i in near]
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("end", pa.int32())])
_NEAR = pa.struct(
    [("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]
)
_SPANS = "array<struct<start:int,kind_no:int,end:int>>"


def scan(docs: DataFrame, *kept: Column) -> DataFrame:
    """(row, item, spans, near), stored: for each row of ``docs`` its protected values and the words around them.

    ``item`` holds the ``kept`` columns, ``row`` is a number of its own.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                texts = chunk.column(1).to_pylist()
                spans = [base_spans(t) for t in texts]
                near = [surroundings(t, s) if s else [] for t, s in zip(texts, spans)]
                columns = [
                    chunk.column(0),
                    pa.array([[x[:3] for x in s] for s in spans], pa.list_(_SPAN)),
                    pa.array(near, pa.list_(_NEAR)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["item", "spans", "near"])

    rows = docs.select(F.struct(*kept).alias("item"), "text")
    near = "array<struct<entity:bigint,term:bigint,context:bigint,start:int,end:int>>"
    schema = f"item {rows.schema['item'].dataType.simpleString()}, spans {_SPANS}, near {near}"
    return stored(in_batches(rows, step, schema).withColumn("row", F.monotonically_increasing_id()))


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, n_documents): in how many rows each word occurs. Summed up within each stretch of rows first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                words = words_of(*text_bytes(chunk.column(0)), _LETTERS)
                order = np.lexsort((words.row, words.hash))
                term, row = words.hash[order], words.row[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                terms, counts = np.unique(term[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts)], ["term", "n"])

    counts = in_batches(docs.select("text"), step, "term bigint, n bigint")
    return counts.groupBy("term").agg(F.sum("n").alias("n_documents"))


def disclosing(found: DataFrame, docs: DataFrame, contexts: int = CONTEXTS, least: float = GENERALISED) -> DataFrame:
    """(entity, term, share), stored: words that disclose a protected value near them, and how much of it.

    All counts are of whole documents in all of ``docs``; a value that is everywhere has no information to disclose.
    """
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.context")
    pairs = near.groupBy("entity", "term").agg(
        F.count_distinct("row").alias("n_both"), F.count_distinct("context").alias("n_contexts")
    )
    pairs = stored(pairs.where(F.col("n_contexts") >= contexts).drop("n_contexts"))
    entities = pairs.select("entity").distinct()
    values = near.join(entities, "entity", "left_semi").groupBy("entity").agg(F.count_distinct("row").alias("n_entity"))
    terms = document_counts(docs).join(pairs.select("term").distinct(), "term", "left_semi")
    n = found.count()
    information = F.log2(F.lit(n) / F.col("n_entity"))
    share = 1 + F.log2(F.col("n_both") / F.col("n_documents")) / F.nullif(information, F.lit(0.0))
    shares = pairs.join(values, "entity").join(terms, "term").select("entity", "term", share.alias("share"))
    return stored(shares.where(F.col("share") >= least))


def mark(docs: DataFrame, *kept: Column, removed: float = REMOVED) -> DataFrame:
    """(item, spans) of each row: all spans by start, then kind, base ones and disclosing words.

    A word near two values has the stronger mark.
    """
    found = scan(docs, *kept)
    terms = disclosing(found, docs)
    near = found.select("row", F.explode("near").alias("x")).select("row", "x.entity", "x.term", "x.start", "x.end")
    # stored between join and grouping, so that a pair with very many rows is split
    marked = stored(near.join(terms, ["entity", "term"]).select("row", "start", "end", "share"))
    words = marked.groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= removed, NAMES.index("removed")).otherwise(NAMES.index("general"))
    words = words.groupBy("row").agg(F.collect_list(F.struct("start", kind.alias("kind_no"), "end")).alias("words"))
    none = F.from_json(F.lit("[]"), _SPANS)
    spans = F.array_sort(F.concat("spans", F.coalesce(F.col("words").cast(_SPANS), none)))
    return found.drop("near").join(words, "row", "left").select("item", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    named = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"]))
    return F.array_join(named, ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, all spans, and how many words disclose a value."""
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind_no"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda s: s["kind_no"] < BASE)
    return mark(docs, F.col("doc_id")).select(
        F.col("item.doc_id").alias("doc_id"),
        *(count(i).alias(f"n_{name}") for i, name in enumerate(NAMES[:BASE])),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        *(count(i).alias(f"n_{NAMES[i]}") for i in range(BASE, len(NAMES))),
    )


def sanitised_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its sign; where spans overlap, the first one's stands for all of them."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            sign = KINDS[NAMES[kind]]
            out += [text[at:start], f"{text[start]}*" if sign is None else sign]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with protected values and the words that disclose them replaced in ``text``; all rows and columns stay.

    ``n_chars``, if there, is counted anew for changed texts.
    """
    whole = [F.col(f"`{c}`") for c in docs.columns]
    marked = mark(docs, *whole).select("item", F.col("item.text").alias("text"), "spans")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch):
                texts, spans = chunk.column(1).to_pylist(), chunk.column(2).to_pylist()
                new = [
                    sanitised_text(t, [(x["start"], x["kind_no"], x["end"]) for x in s]) if s else None
                    for t, s in zip(texts, spans)
                ]
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(new, pa.string())], ["item", "new"])

    out = in_batches(marked, step, f"item {marked.schema['item'].dataType.simpleString()}, new string")
    fresh = {"text": F.coalesce("new", "item.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fresh["n_chars"] = F.when(F.col("new").isNull(), F.col("item.n_chars")).otherwise(F.length("new")).cast(kind)
    return out.select(*(fresh.get(c, F.col("item").getField(c)).alias(c) for c in docs.columns))
