"""Personal data: fixed patterns, and contexts that they teach.

The fixed patterns find seed entities. The words around a seed make a lexical pattern; patterns and the values in their
slots form a graph, which Spark scores in rounds: a pattern is as sure as the share of its distinct values that are
already trusted, and a value is as sure as its patterns together. Values that only look like an identifier (a number
that fails a check, say) are taken when sure enough. Only mentions and their contexts are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch

# Kinds in order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digits are taken whole from where they begin: a later start in the same digits can't match either.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What may be an identifier: digits, perhaps in groups, and words with an at sign.
LOOSE = re.compile(r"(?<![A-Za-z0-9])(?=[0-9(])\(?[0-9]++(?:[ ().-]{1,2}[0-9]++)*+(?![A-Za-z0-9])")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = frozenset(" \t\n\x0b\x0c\r")
TRIM = ".,;:!?\"'()[]<>|"

#: A pattern counts with so many distinct seeds and such a share of trusted values; a value, from such a score.
LEAST_SEEDS, LEAST_SHARE, LEAST_SCORE, ROUNDS = 5, 0.8, 0.9, 3
#: Parts that the rows of a common pattern or value are dealt into before a join.
SALTS = 16
SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:int,start:int,end:int>>, "
    "mentions array<struct<kind:int,start:int,end:int,seed:boolean,value:string,contexts:array<string>>>"
)


RESULTS = ("row_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "learnt")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start, in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _candidates(text: str, taken: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Spans outside the base ones that could be of a kind: words with an at sign, dotted quads, 12 to 19 digits for a
    card, 7 to 15 for a phone. Digits that could be of two kinds are of both; the patterns decide."""
    held = sorted((a, b) for _, a, b in taken)
    at = 0
    for m in WORD.finditer(text) if "@" in text else ():
        a = m.start() + len(m[0]) - len(m[0].lstrip(TRIM))
        b = m.start() + len(m[0].rstrip(TRIM))
        while at < len(held) and held[at][1] <= a:
            at += 1
        if (at == len(held) or held[at][0] >= b) and "@" in text[a + 1 : b - 1]:
            yield 0, a, b
    at = 0
    for m in LOOSE.finditer(text):
        a, b = m.span()
        while at < len(held) and held[at][1] <= a:
            at += 1
        if at < len(held) and held[at][0] < b:
            continue
        n = sum(c.isdigit() for c in m[0])
        if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", m[0]):
            yield 1, a, b
        if 12 <= n <= 19:
            yield 2, a, b
        if 7 <= n <= 15:
            yield 3, a, b


def _word_before(text: str, end: int) -> tuple[str, int]:
    """The word before a place, and where it begins; of a very long word only the end, which is too long for a context."""
    while end and text[end - 1] in SPACES:
        end -= 1
    start = end
    while start and text[start - 1] not in SPACES and end - start < 80:
        start -= 1
    return text[start:end], start


def _word_after(text: str, start: int) -> str:
    """The word, or its rest, that begins at a place or after the spaces there; of a very long word only the beginning."""
    while start < len(text) and text[start] in SPACES:
        start += 1
    end = start
    while end < len(text) and text[end] not in SPACES and end - start < 80:
        end += 1
    return text[start:end]


def _contexts(text: str, a: int, b: int) -> list[str]:
    """Patterns of a span: the two words before it; the word before and the word after, however far off. Long words are
    no context."""
    last, at = _word_before(text, a)
    first, _ = _word_before(text, at)
    first, last, after = (w.strip(TRIM).lower() for w in (first, last, _word_after(text, b)))
    out = []
    if 0 < len(first) < 40 and 0 < len(last) < 40:
        out.append(f"{first} {last} _")
    if 0 < len(last) < 40 and 0 < len(after) < 40:
        out.append(f"{last} _ {after}")
    return out


def _value(text: str, kind: int) -> str:
    """What a mention is known by: its text, of digits in groups without what parts them; a very long one, its digest."""
    value = text if kind == 1 else re.sub(r"[ ().-]", "", text)
    return value if len(value) <= 64 else hashlib.sha256(value.encode()).hexdigest()


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Each row's base spans and mentions with contexts, beside the columns ``keep``; null counts as the empty text.
    Texts are read whole, rows stay where they are read, repeated ones are rows like others."""
    source = documents.select(*dict.fromkeys([*keep, "text"]))
    schema = f"{source.select(*keep).schema.toDDL()}, {SCHEMA}"
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, base, mentions = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = base_spans(text)
                counts.append([sum(k == kind for k, _, _ in found) for kind in range(4)])
                digests.append(hashlib.sha256(joined(found).encode()).hexdigest())
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                every = [(True, *x) for x in found] + [(False, *x) for x in _candidates(text, found)]
                mentions.append([{"kind": k, "start": a, "end": b, "seed": s, "value": _value(text[a:b], k), "contexts": _contexts(text, a, b)} for s, k, a, b in every])
            columns = [*map(batch.column, keep), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(digests, pa.string()), pa.array(base, pa.list_(span)), pa.array(mentions, pa.list_(mention))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"])

    return source.mapInArrow(run, schema)


def row_key():
    """Names a row by its id and text, so that repeated ids with other texts stay apart."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def _copied(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def trusted_values(mentions: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, score) of mentions that aren't seeds but whose contexts are those of seeds.

    ``mentions`` has kind, value, seed, contexts. Edges are distinct, so a value that is repeated, in however many
    rows, counts once; the sums are combined before each shuffle, so a common pattern doesn't fill one task.
    """
    edges = scratch.save(mentions.select("kind", "value", "seed", F.explode("contexts").alias("pattern")).groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")), "edges")
    values = edges.where("seed").groupBy("kind", "value").agg(F.lit(1.0).alias("score"))
    found = edges.where(F.lit(False)).select("kind", "value", F.lit(0.0).alias("score"))
    for n in range(rounds):
        scored = edges.join(values.unionByName(found).groupBy("kind", "value").agg(F.max("score").alias("score")), ["kind", "value"], "left")
        patterns = (
            scored.groupBy("pattern", "kind")
            .agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("trusted"), F.count("*").alias("n"), F.count_if("seed").alias("seeds"))
            .where((F.col("seeds") >= LEAST_SEEDS) & (F.col("trusted") >= LEAST_SHARE * F.col("n")))
            .select("pattern", "kind", (F.col("trusted") / (F.col("n") + 1)).alias("share"))
        )
        found = scratch.save(
            _dealt(edges.where(~F.col("seed")), "value")
            .join(_copied(patterns), ["pattern", "kind", "salt"])
            .groupBy("kind", "value")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("share"), F.lit(0.999)))))).alias("score"))
            .where(F.col("score") >= 0.5),
            f"found{n}",
        )
    return found.where(F.col("score") >= LEAST_SCORE)


def extract(documents: DataFrame, keep: list[str]) -> DataFrame:
    """Base counts, base spans and learnt spans (``learnt``, an array like ``base``) of every row, beside ``keep`` and
    ``row_key``, which names the row's id and text.

    A null text counts as empty, without spans; so an empty table gives an empty one. Repeated rows are rows like others,
    but the values in them count once. Whole texts are read, however long. Kept columns that bear a result's name are
    replaced.
    """
    scratch = Scratch(documents.sparkSession, "pii")
    names = [c for c in keep if c not in RESULTS]
    row = [F.struct(*map(F.col, names)).alias("row")] if names else []
    rows = scratch.save(scan(documents.select(*row, row_key().alias("row_key"), "text"), [*(["row"] if names else []), "row_key"]), "rows")
    mentions = rows.select("row_key", F.explode("mentions").alias("m")).select("row_key", "m.*")
    trusted = trusted_values(mentions, scratch)
    learnt = (
        _dealt(mentions.where(~F.col("seed")).select("row_key", "kind", "start", "end", "value"), "row_key")
        .join(_copied(trusted), ["kind", "value", "salt"])
        .groupBy("row_key", "start", "end")
        .agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        .groupBy("row_key")
        .agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("learnt"))
    )
    empty = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    out = rows.drop("mentions").join(learnt, "row_key", "left").withColumn("learnt", F.coalesce("learnt", empty))
    return out.select(*(["row.*"] if names else []), *RESULTS)


def spans_text(spans):
    """kind:start:end, by kind and start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(documents: DataFrame) -> DataFrame:
    """The rows with each personal span replaced by its kind in angle brackets; other columns, and null texts, as they are.

    Spans that overlap are replaced together, under the kind of the first.
    """
    found = extract(documents, []).select("row_key", F.concat("base", "learnt").alias("spans")).where(F.size("spans") > 0).dropDuplicates(["row_key"])
    marked = documents.select(F.struct("*").alias("row"), row_key().alias("row_key")).join(found.hint("merge"), "row_key", "left")

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, marks in zip(texts, spans, strict=True):
            if text is not None and marks is not None:
                parts, at = [], 0
                for a, b, k in sorted((m["start"], m["end"], m["kind"]) for m in marks):
                    if a >= at:
                        parts += [text[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, b)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    text = F.col("row")["text"]
    changed = F.when(F.col("spans").isNull(), text).otherwise(cut(text, F.col("spans"))).alias("text")
    return marked.select(*(changed if c == "text" else F.col("row")[c].alias(c) for c in documents.columns))
