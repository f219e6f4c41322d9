"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds the measurements and one integer whose
bits name the rules that failed; a policy is a named mask over those bits. Applying a policy,
comparing versions and ablating a rule are bitwise operations on that integer and never read a text.

Defined results: null text has no words (all measurements 0, so `too_few_words` fails); repeated rows
are judged row by row; an empty table gives an empty ledger; other columns of the input are kept
untouched unless a ledger column has the same name, which then replaces it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveworks.llm._common import as_bytes, slices

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper_words", "n_bangs",
)

#: Rule by bit: its name and the SQL test over the measurements that says it failed.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_density", "10 * n_symbols > 3 * n_words"),
    ("word_length_low", "2 * word_chars < 5 * n_words"),
    ("word_length_high", "word_chars > 14 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    ("shouting", "100 * n_upper_words > 50 * n_words"),
    ("exclamations", "100 * n_bangs > 60 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["too_few_words"] | BIT["repeated_words"]

#: Versioned policies: the rules that a document must pass.
POLICIES = {
    "base-1": BASE,
    "web-1": BASE | BIT["symbol_density"] | BIT["duplicate_lines"],
    "web-2": (1 << len(RULES)) - 1,
}
DEFAULT_POLICY = "web-2"

_SYMBOLS = b"#*$%&|<>"


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()  # bytes split on exactly U+0020 and U+0009 to U+000D
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, _SYMBOLS)), 0, 0, 0, 0, text.count(b"!"))
    repeated = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            ids: dict[tuple, int] = {}
            at = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, n - 2)
            twice = (np.bincount(at) > 1)[at]
            covered = np.zeros(n, bool)
            covered[:-2] = twice
            covered[1:-1] |= twice
            covered[2:] |= twice
            repeated = int(covered.sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        n,
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(w.isupper() for w in words),
        text.count(b"!"),
    )


def _measured(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            got = np.array([_measure(x) for x in as_bytes(batch.column(0))], np.int64).reshape(-1, len(MEASURES))
            own = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(own + [pa.array(got[:, i]) for i in range(len(MEASURES))], names)

    return run


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and failure bits of every row: columns `keep`, then MEASURES, then `failed_bits`.

    One pass without a shuffle; rows in, rows out.
    """
    own = [c for c in keep if c not in MEASURES]
    source = docs.select(F.col(text).cast("string").alias("_text"), *own)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    measured = source.mapInArrow(_measured([*own, *MEASURES]), ", ".join([*kinds, *(f"{m} long" for m in MEASURES)]))
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, test) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed_bits", total.cast("int"))


def passes(policy: str = DEFAULT_POLICY, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that fail nothing else, rows kept with and without it.

    The ledger is first summed by failure bits (2**rules rows at most), so the rules are compared on
    counts of bit patterns and the documents are read once.
    """
    mask = POLICIES[policy]
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << i).alias("bit")) for i, (name, _) in enumerate(RULES) if mask >> i & 1]
    each = patterns.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    only = F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)
    kept = F.when(F.col("bits") == 0, F.col("n")).otherwise(0)
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(only).alias("failed_alone"),
        F.sum(kept).alias("kept"),
        F.sum(kept + only).alias("kept_without"),
    )


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows of `docs` that pass a policy, with their own columns, whatever their names."""
    book = ledger(docs.select(F.struct("*").alias("row"), F.col("text").alias("body")), "body", ("row",))
    return book.where(passes(policy)).select("row.*")
