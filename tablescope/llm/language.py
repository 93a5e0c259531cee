"""Operator 8, language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A document is cut greedily into phrases, each the
longest match with the language's text from where the last one ended; few phrases mean that the text is well described.
The number of phrases times log2 of the training length, per character, estimates the cross entropy, and the least wins.
Texts are cut into lanes of equal length, and all lanes of a batch walk through all automata side by side.
"""
from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import with_carried

LANE = 256  # characters that are parsed in one go; every lane begins a new phrase
CHARS = 1 << 20  # characters of texts that a task parses side by side
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, bits map<string,double>"


@lru_cache(1)
def letters() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def plain(text: str) -> np.ndarray:
    """Lower-cased code points of the letters; anything between two letters becomes one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, 32)[keep]


class Automaton:
    """States and edges of a suffix automaton; state 0 is the root."""

    def __init__(self, codes: list[int]):
        link, length, edges, last = [-1], [0], [{}], 0
        for c in codes:
            own = len(link)
            length.append(length[last] + 1)
            link.append(0)
            edges.append({})
            p = last
            while p != -1 and c not in edges[p]:
                edges[p][c] = own
                p = link[p]
            if p != -1:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[own] = q
                else:
                    copy = len(link)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    edges.append(dict(edges[q]))
                    while p != -1 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[own] = copy
            last = own
        self.states = len(link)
        self.source = np.repeat(np.arange(self.states, dtype=np.int32), [len(e) for e in edges])
        self.symbol = np.array([c for e in edges for c in e], np.int32)
        self.to = np.array([t for e in edges for t in e.values()], np.int32)


class Model:
    """Automata of all languages over one alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        plains = {k: np.concatenate([np.append(plain(t), 32) for t in v]) for k, v in sorted(texts.items())}
        self.langs = list(plains)
        self.alphabet = np.unique(np.concatenate([*plains.values(), [32]]))
        self.cost = [float(np.log2(max(2, len(p)))) for p in plains.values()]
        self.automata = [Automaton((np.searchsorted(self.alphabet, p) + 1).tolist()) for p in plains.values()]

    def table(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Next state for (state, symbol) over all languages, -1 where none; the roots; symbols per state. Symbol 0 is unknown."""
        width = len(self.alphabet) + 1
        base = np.concatenate([[0], np.cumsum([a.states for a in self.automata])]).astype(np.int64)
        out = np.full((base[-1], width), -1, np.int32)
        for a, b in zip(self.automata, base):
            out[a.source + b, a.symbol] = a.to + b
        return out.reshape(-1), base[:-1].astype(np.int64), width

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0).astype(np.int32)


def phrases(symbols: np.ndarray, table: np.ndarray, roots: np.ndarray, width: int) -> np.ndarray:
    """(languages, lanes): greedy longest-match phrases of each lane; symbols is (steps, lanes), -1 behind a lane's end."""
    steps, lanes = symbols.shape
    start = np.repeat(roots, lanes)
    state, count = start.copy(), np.zeros(len(start), np.int32)
    for t in range(steps):
        c = np.tile(symbols[t], len(roots))
        on = c >= 0
        if not on.any():
            break
        after = table[state * width + np.where(on, c, 0)]
        fail = on & (after < 0)
        count += fail
        again = table[start[fail] * width + c[fail]]  # the next phrase begins with this character
        after[fail] = np.where(again < 0, start[fail], again)
        state = np.where(on, after, state)
    # a phrase is counted when it breaks; the last one of a lane is counted here
    return count.reshape(len(roots), lanes) + (symbols[0] >= 0)


def _label(sent, modulus: int, held: int, carried_text: str | None = None):
    import zlib

    def run(batches):
        model = sent.value
        table, roots, width = model.table()
        cost = np.array(model.cost)
        for batch in batches:
            column = batch.column("carried").field(carried_text) if carried_text else batch.column("text")
            ids, texts = batch.column("doc_id").to_pylist(), column.to_pylist()
            done = 0
            while done < len(texts):
                size, upto = 0, done
                while upto < len(texts) and (upto == done or size + len(texts[upto] or "") <= CHARS):
                    size += len(texts[upto] or "")
                    upto += 1
                codes = [plain(t) if t else np.zeros(0, np.uint32) for t in texts[done:upto]]
                chars = np.array([len(c) for c in codes])
                lanes = -(-chars // LANE)
                first = np.concatenate([[0], np.cumsum(lanes)])
                grid = np.full((int(first[-1]), LANE), -1, np.int32)
                if len(grid):
                    place = np.concatenate([np.arange(len(c)) + f * LANE for c, f in zip(codes, first)])
                    grid.reshape(-1)[place] = model.symbols(np.concatenate(codes))
                total = np.zeros((len(model.langs), len(grid) + 1))
                step = 1 << 14
                for a in range(0, len(grid), step):
                    total[:, 1 + a:1 + a + step] = phrases(np.ascontiguousarray(grid[a:a + step].T), table, roots, width)
                total = np.cumsum(total, axis=1)
                bits = (total[:, first[1:]] - total[:, first[:-1]]) * cost[:, None] / np.maximum(chars, 1)
                out = []
                for j, (doc, n) in enumerate(zip(ids[done:upto], chars)):
                    order = np.argsort(bits[:, j], kind="stable")
                    if not n or not len(order):
                        lang, score = "und", 0.0
                    else:
                        best, second = bits[order[0], j], bits[order[1], j] if len(order) > 1 else np.inf
                        lang, score = model.langs[order[0]], float(1 - best / second)
                    out.append((doc, doc is not None and zlib.crc32(str(doc).encode()) % modulus == held, lang, score,
                                list(zip(model.langs, map(float, bits[:, j]))) if n else []))
                kinds = pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64())
                along = {k: batch.column(k).slice(done, upto - done) for k in batch.schema.names if k == "carried"}
                yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*out), kinds)), *along.values()],
                                                 ["doc_id", "held_out", "lang_pred", "score", "bits", *along])
                done = upto
    return run


def learn(docs: DataFrame, chars: int = 60_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", modulus: int = 4, held: int = 2) -> Model:
    """Automata of at most about `chars` characters per language (the documented bound of the labelled sample), from
    whole documents chosen by a hash of their id, those with crc32(id) mod `modulus` = `held` left out."""
    known = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"),
                        F.xxhash64(F.col(doc_id).cast("long"), F.lit(8)).alias("h")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(modulus)) != held))
    totals = {r["lang"]: (r["n"], r["m"]) for r in known.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.max(F.length("text")).alias("m")).collect()}
    if not totals:
        return Model({})
    # twice the share of documents that is wanted on average; the running total then cuts at the bound
    share = F.lit(0.0)
    for name, (n, m) in totals.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, (2.0 * chars + 4 * m) / max(n, 1)))).otherwise(share)
    some = known.where((F.shiftrightunsigned("h", 11) / float(1 << 53)) <= share)
    run = Window.partitionBy("lang").orderBy("h", "id", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = some.withColumn("upto", F.sum(F.length("text")).over(run)).where(F.col("upto") - F.length("text") < chars).orderBy("lang", "h", "id", "text").collect()
    texts: dict[str, list[str]] = {}
    for r in rows:
        have = sum(map(len, texts.setdefault(r["lang"], [])))
        if not have or have + len(r["text"]) <= chars * 1.2:
            texts[r["lang"]].append(r["text"])
    return Model(texts)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", modulus: int = 4, held: int = 2,
             carry: list[str] | None = None) -> DataFrame:
    """One row per document: held_out, lang_pred, score (how much shorter the best description is than the second, 0 to
    1) and the bits per letter under each language.

    NULL texts and texts without a letter are `und` with score 0; a NULL id is not held out; ties go to the first
    language by code point; equal rows get equal results; other columns are not looked at; those in `carry` come back as a struct `carried`. Nothing but the text decides.
    """
    own, along = with_carried(docs, doc_id, text, carry)
    inside = text if carry and text in carry and docs.schema[text].dataType.typeName() == "string" else None
    if inside:  # texts are not sent twice
        own = own.drop("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the languages and the sample's bound, not the table
    return own.mapInArrow(_label(sent, modulus, held, inside), RESULT + along)


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select("doc_id", "held_out", "lang_pred", "score")
