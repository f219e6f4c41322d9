"""Secrets by character Markov models.

Two bigram models over ASCII characters, one of random strings (keys, tokens, hashes) and one of
ordinary identifiers and words, are trained from labelled samples; a token whose log-likelihood ratio
reaches a threshold calibrated on other samples is a secret. Spans of the three base
patterns are always kept; a token found by the models is added where it overlaps no base span.

The samples are generated with a fixed seed: `train_rows` of each label (a documented bound, the same at
every data size). Pass other labelled tokens to `SecretModel` to train on them.

Defined results: null and empty text have no spans; offsets are code points, end exclusive; repeated rows
repeat; an empty table stays empty; texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm._common import covered, slices
from sieveworks.llm.boosting import threshold_for

#: Base kinds, then the kind that the models add, in the order that breaks ties.
KINDS = ("assign", "access", "hex", "random")
Span = tuple[str, int, int]

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Whatever may be a key: every run of these characters of at least LEAST_CHARS, letters alone included. The models judge it.
LEAST_CHARS = 12
_TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST_CHARS},}}")


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each base pattern that do not overlap, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class MarkovModel:
    """Add-half smoothed bigram model over ASCII; code 0 stands for the edges and all other characters."""

    def __init__(self, tokens: Iterable[str]):
        count = np.full((128, 128), 0.05)
        for t in tokens:
            c = codes(t)
            np.add.at(count, (c[:-1], c[1:]), 1.0)
        self.log = np.log(count / count.sum(1, keepdims=True))

    def score(self, token: str) -> float:
        c = codes(token)
        return float(self.log[c[:-1], c[1:]].sum())


def codes(token: str) -> np.ndarray:
    c = np.frombuffer(("\0" + token + "\0").encode("ascii", "replace"), np.uint8).astype(np.int64)
    return np.where(c < 128, c, 0)


#: Alphabets of keys and tokens, what issuers put in front, parts of words in four languages and of identifiers.
_ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
_PREFIXES = ("", "", "", "", "ghp_", "sk-", "xoxb-", "pk_live_", "glpat-", "AIza")
_PARTS = (
    "get set is has make find read write open close load store user name file path list map item value key index count size time date data base table row column "
    "page block line text word char string number int float bool array object node tree graph edge test main config option default error event handler manager "
    "service client server request response session token auth login api http url json xml html css image video audio stream buffer queue stack cache lock thread "
    "task job worker pool driver module package class method function update delete insert select order group filter sort merge split join parse format print "
    "debug info warn"
).split()
_SYLLABLES = (
    "the and ing tion ent er re on an in ed nd ha at en es of or nt ti to it ly ble sh wh th ou st al is ar le se ness ment ful less under over inter "
    "der die und ein ich sch ung gen keit heit ver zu lich te ge be auf aus ach pf tz ei ie el "
    "les que eur ait est eau aux eil ouv ette oir ez tr pr ce mais vous nous aire ant "
    "con ado ar os dad ando mente ciones ero ista que por para lo ña cion aje oso illa do"
).split()


def _ordinary(r: random.Random) -> str:
    """A word, an identifier, a path, an address, a number: what stands in texts and is no key."""
    word = lambda: "".join(r.choices(_SYLLABLES, k=r.randint(2, 6)))
    words = [r.choice(_PARTS) if r.random() < 0.6 else word() for _ in range(r.randint(2, 6))]
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    style = r.randrange(15)
    if style < 3:
        t = "".join(r.choices(_SYLLABLES, k=r.randint(3, 8)))
        t = (t, t.capitalize(), t.upper())[style]
    elif style == 3:
        t = "_".join(words)
    elif style == 4:
        t = words[0] + "".join(w.capitalize() for w in words[1:])
    elif style == 5:
        t = "".join(w.capitalize() for w in words)
    elif style == 6:
        t = "/".join(words) + r.choice((".py", ".html", ".json", ".jpg", ""))
    elif style == 7:
        t = "-".join(words) + r.choice(("", f"-{r.randint(1, 2030)}"))
    elif style == 8:
        t = ".".join(words)
    elif style == 9:
        t = "_".join(words).upper()
    elif style == 10:
        t = ".".join(str(r.randint(0, 255)) for _ in range(4))
    elif style == 11:
        t = r.choice((f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}", f"{digits(3)}-{digits(3)}-{digits(4)}", digits(r.randint(9, 16)), f"{digits(3)}.{digits(r.randint(8, 16))}"))
    elif style == 12:
        t = f"www.{word()}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}/{word()}"
    elif style == 13:
        t = r.choice("-=_.") * r.randint(12, 40)
    else:
        t = word() + r.choice("-./") + word() + r.choice(("", "=", "/", "..."))
    if r.random() < 0.2:
        t += r.choice(("_", "", "-v")) + str(r.randint(0, 99))
    return t.encode("ascii", "replace").decode()


def labelled_samples(n: int, seed: int = 5) -> tuple[list[str], list[str]]:
    """n generated random strings and n generated ordinary tokens, all of LEAST_CHARS characters or more."""
    r = random.Random(seed)
    secrets = [r.choice(_PREFIXES) + "".join(r.choices(r.choice(_ALPHABETS), k=r.randint(LEAST_CHARS, 48))) for _ in range(n)]
    plain: list[str] = []
    while len(plain) < n:
        t = _ordinary(r)
        if len(t) >= LEAST_CHARS:
            plain.append(t)
    return secrets, plain


class SecretModel:
    """Log-likelihood ratio of two Markov models over the whole token, with a calibrated threshold.

    The ratio grows with the length of a random token, so that a short one must look the more random. `prior`
    is the log of how many ordinary tokens a text has for each secret; the threshold is no lower. Training,
    calibration and the held-out accuracy use samples of different seeds, or thirds of the tokens passed in.
    """

    def __init__(self, secrets: list[str] | None = None, plain: list[str] | None = None, train_rows: int = 6000, precision: float = 0.999, prior: float = 25.0):
        if secrets is None or plain is None:
            sets = [labelled_samples(train_rows, seed) for seed in (5, 6, 7)]
        else:
            sets = [(secrets[i::3], plain[i::3]) for i in range(3)]
        self.random, self.ordinary = (MarkovModel(x) for x in sets[0])
        (cal, y), (held, z) = (self._scored(*x) for x in sets[1:])
        self.threshold = max(prior, threshold_for(cal, y, precision))
        self.held_out_accuracy = float(((held >= self.threshold) == (z > 0)).mean())
        self.held_out_precision = float(z[held >= self.threshold].mean())

    def _scored(self, secrets: list[str], plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.ratio(t) for t in [*secrets, *plain]]), np.array([1.0] * len(secrets) + [0.0] * len(plain))

    def ratio(self, token: str) -> float:
        return self.random.score(token) - self.ordinary.score(token)

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans, each by start, then kind."""
        base = base_spans(text)
        taken, at = covered(base), 0
        added = []
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            if at < len(taken) and taken[at][0] < b:
                continue
            token = m[0].strip(".=-/")
            if len(token) >= LEAST_CHARS and self.ratio(token) >= self.threshold:
                start = a + m[0].index(token)
                added.append(("random", start, start + len(token)))
        return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]))) if added else base


_model: list[SecretModel] = []


def model() -> SecretModel:
    """The model of this process, trained on first use; the same everywhere."""
    if not _model:
        _model.append(SecretModel())
    return _model[0]


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, base_spans and spans (arrays of kind, start, end), one row per row of docs."""
    own = [c for c in keep if c not in ("base_spans", "spans")]
    source = docs.select(F.col(text).cast("string").alias("_text"), *own)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = model().spans
        for batch in slices(batches, 1000):
            got = [find(t or "") for t in batch.column(0).to_pylist()]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in g[k]] for g in got], _SPANS_ARROW) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), *cols], [*own, "base_spans", "spans"])

    return source.mapInArrow(run, ", ".join([*kinds, f"base_spans {_SPANS}, spans {_SPANS}"]))
