"""Personal data by candidate spans and gradient-boosted trees.

High-recall generators propose overlapping spans of every kind; each candidate gets features of its form
and context; boosted trees score it and a threshold per kind, calibrated on other samples for its
precision, selects what is redacted. Spans of the four base patterns are always kept. A selected
candidate is added where it overlaps no base span and no better candidate. The trees are trained on
`train_rows` generated labelled samples and calibrated on `calibration_rows` others (documented bounds, the
same at every data size) with fixed seeds, so that every run gives the same model.

Defined results: null and empty text have no spans; offsets are code points, end exclusive; repeated rows
repeat; an empty table stays empty; texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm._common import covered, slices
from sieveworks.llm.boosting import BoostedTrees, threshold_for

#: Base kinds, then the kinds that only the trees add, in the order that breaks ties.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "ipv6", "mac", "handle")

Span = tuple[str, int, int]

_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL_AT = re.compile(_EMAIL)
_EMAIL_FROM = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches that do not overlap. A match starts where a run of local characters starts, or where the last one ended."""
    at = 0
    while text.find("@", at) >= 0:
        m = (_EMAIL_AT.match(text, at) if at else None) or _EMAIL_FROM.search(text, at)
        if not m:
            return
        yield "email", m.start(), m.end()
        at = m.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: High-recall patterns by kind. Each repetition is bounded.
GENERATORS = (
    ("email", re.compile(r"(?<![\w.-])[A-Za-z0-9._+-]{2,40} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,30} ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,6}(?!\w)")),
    ("email", re.compile(r"(?<![\w.-])[A-Za-z0-9._+-]{2,40} at [A-Za-z0-9-]{2,30} dot [A-Za-z]{2,6}(?!\w)")),
    ("phone", re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.-])0[0-9]([ .-])(?:[0-9]{2}\1){3}[0-9]{2}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.-])\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{5,9}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.-])[6-9][0-9]{2}(?: [0-9]{2}){3}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+.-])00[1-9][0-9 ()-]{7,16}[0-9](?!\w)")),
    ("card", re.compile(r"(?<![\w.])[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ipv6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?(?:[0-9A-Fa-f]{1,4}:?){0,5}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("mac", re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![\w:-])")),
    ("handle", re.compile(r"(?<![\w@.])@[A-Za-z_][A-Za-z0-9_]{3,29}(?!\w)")),
)
_HINTS = re.compile(r"[0-9@]|\((?:at|dot)\)|\[(?:at|dot)\]| dot ")
#: Words of four languages that announce a kind, and words that announce numbers and names of other kinds.
CUES = {
    "email": ("mail", "contact", "write", "reach", "kontakt", "schreib", "courriel", "écri", "correo", "escrib"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "anruf", "rufnummer", "handy", "télé", "appel", "portable", "llam", "móvil", "contacto"),
    "card": ("card", "visa", "credit", "paid", "amex", "karte", "carte", "tarjeta", "mastercard"),
    "ssn": ("ssn", "social", "security", "tax", "sozialvers", "sécurité", "seguridad"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweis", "compte", "virement", "cuenta"),
    "ipv6": ("ip", "address", "host", "client", "server", "adresse", "dirección"), "mac": ("mac", "device", "hardware", "gerät", "appareil", "dispositivo"),
    "handle": ("twitter", "follow", "instagram", "user", "folg", "suivez", "sígue", "mastodon", "telegram"),
}
OTHER = (
    "isbn", "order", "version", "invoice", "page", "serial", "sku", "part", "item", "article", "ticket", "room", "figure", "table", "between", "score", "lot ", "bestell",
    "rechnung", "seite", "artikel", "teil", "commande", "facture", "pièce", "pedido", "factura", "pieza", "página", "date", "datum", "fecha", "decorator", "import", "def ", "css",
)
_FILLER = (
    "the of and to in is that for it was on are as with his they at be this from", "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "de la le et les des en un du une que est pour qui dans a par plus pas au", "de la que el en y a los del se las por un para con no una su al lo",
)


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "").upper()
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[Span]:
    """Overlapping spans of all generators."""
    if not _HINTS.search(text):
        return []
    return [(kind, m.start(), m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)]


def features(text: str, span: Span) -> list[float]:
    """Form of the span and words around it. No feature says more than the text does: kinds that only context tells apart share the same ones."""
    kind, a, b = span
    s, left, right = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 2]
    digits = "".join(c for c in s if c.isdigit())
    letters = sum(c.isalpha() for c in s)
    groups = re.findall(r"[0-9]+", s)
    checked = luhn(digits) if kind == "card" else iban_valid(s) if kind == "iban" else False
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), len(digits) / len(s), letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(checked), float("(at)" in s or "[at]" in s or "(dot)" in s or "[dot]" in s), float(" at " in s), float(" dot " in s or "(dot)" in s or "[dot]" in s),
        float(any(c in left for c in CUES.get(kind, ()))), float(any(c in left for c in OTHER)), float(left[-1:].isspace() or not left), float(left.rstrip()[-1:] == ":"),
        float(right[:1] in ("", " ", ".", ",", ";", ")", "\n")), float(right[:1] == "("), float(s[:1] == "("), float(len(set(digits))), float(digits[:1] == "0"),
        float(groups[0] in ("000", "666") or groups[0][:1] == "9" if groups else 0), float("::" in s), float(s.count(":")), float(s.upper() == s), float("." in s), float("-" in s), float(" " in s),
    ]


def _sample(r: random.Random) -> tuple[str, Span, int] | None:
    """One generated labelled span in a context of one of four languages. Either label may come with or without an announcing word."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(r.choice(("an", "er", "on", "tion", "th", "mo", "lis", "ka", "re", "pol", "schu", "ein", "eau", "oir", "ado", "cion")) for _ in range(r.randint(1, 3)))
    filler = r.choice(_FILLER).split()
    some = lambda n: " ".join(r.choice(filler) if r.random() < 0.6 else word() for _ in range(n))
    top = lambda: r.choice(("com", "org", "net", "de", "fr", "es", "io"))
    kind = r.choice(("email", "phone", "phone", "card", "ssn", "iban", "ipv6", "mac", "handle"))
    good = r.random() < 0.5
    if kind == "email":
        at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", ".")))
        s = f"{word()}{r.choice('._-')}{word()}{at}{word()}{dot}{top()}" if good else f"{r.choice(filler)} at {word()} dot {word()[:6]}"
    elif kind == "phone":
        s = r.choice((
            f"({digits(3)}) 555-{digits(4)}", f"{r.randint(2, 9)}{digits(2)}-{digits(3)}-{digits(4)}", f"0049 {digits(3)} {digits(6)}", f"0{r.randint(1, 9)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
            f"0{r.randint(1, 9)}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", f"0{r.randint(2, 9)}0 {digits(r.randint(6, 8))}", f"0{r.randint(2, 9)}{digits(2)}/{digits(r.randint(5, 8))}", f"{r.randint(6, 9)}{digits(2)} {digits(2)} {digits(2)} {digits(2)}",
        )) if good else r.choice((
            f"{digits(4)}-{digits(4)}-{digits(4)}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"{r.randint(1, 9)}{digits(2)} {digits(3)} {digits(3)}", f"{digits(4)} {digits(4)} {digits(4)}", f"20{digits(2)}-{digits(3)}-{digits(3)}",
            f"00{r.randint(1, 9)}{digits(13)}", f"{digits(2)}/{digits(4)}-{digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{r.randint(1, 9)}{digits(1)}-{digits(6)}",
        ))
    elif kind == "card":
        d = r.choice("3456") + digits(14)
        d += next(c for c in "0123456789" if luhn(d + c) == good)
        s = r.choice("./ -").join((d[:4], d[4:8], d[8:12], d[12:]))
    elif kind == "ssn":
        area = r.randint(1, 899) if good else r.choice((0, 666, r.randint(900, 999), r.randint(1, 899)))
        s = f"{area:03d}-{digits(2)}-{digits(4)}"
    elif kind == "iban":
        country = r.choice(("DE", "FR", "ES", "NL", "AT"))
        body = digits(18)
        check = 98 - int(body + "".join(str(int(c, 36)) for c in country) + "00") % 97
        s = f"{country}{check if good else (check + r.randint(1, 90)) % 97:02d}{body}"
    elif kind == "ipv6":
        s = r.choice((":".join(hexa(4) for _ in range(8)), f"{hexa(4)}:{hexa(4)}::{hexa(4)}")) if good else r.choice((f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}:{digits(2)}:{digits(2)}:{digits(2)}"))
    elif kind == "mac":
        s = r.choice(":-").join(hexa(2) for _ in range(6)) if good else "-".join((digits(2),) * 6)
    else:
        s = f"@{word()}{r.choice(('_', '', ''))}{word()}{digits(r.choice((0, 0, 2)))}" if good else "@" + r.choice(("property", "media", "Override", "param", "return", "dataclass", word()))
    roll = r.random()
    bare = 0.25 if kind in ("card", "iban", "ipv6", "mac", "email", "phone") else 0.1
    if good:
        lead = f"{r.choice(CUES[kind])}{r.choice((':', '', ' nr.'))} " if roll > bare else f"{r.choice(OTHER)} " if roll < 0.02 else ""
    else:
        lead = f"{r.choice(OTHER)} " if roll < 0.45 else f"{r.choice(CUES[kind])} " if roll > 0.95 else ""
    left = f"{some(r.randint(1, 5))} {lead}"
    text = f"{left}{s}{r.choice((' ', '. ', ', ', chr(10)))}{some(3)}"
    for span in candidates(text):
        if span[0] == kind and span[1] >= len(left) - 1:
            return text, span, int(good)
    return None


class PiiModel:
    """Boosted trees over candidates and a threshold per kind, calibrated on samples that the trees have not seen.

    `train_rows` and `calibration_rows` are the numbers of generated samples; pass `labelled`, rows of (text,
    span, label), to train and calibrate on those instead (every third one calibrates).
    """

    def __init__(self, train_rows: int = 4000, calibration_rows: int = 3000, precision: float = 0.98, seed: int = 11, labelled: list[tuple[str, Span, int]] | None = None):
        made = lambda n, k: [s for s in (_sample(r) for r in [random.Random(k)] for _ in range(n)) if s]
        if labelled:
            train, held = [x for i, x in enumerate(labelled) if i % 3], labelled[::3]
        else:
            train, held = made(train_rows, seed), made(calibration_rows, seed + 1)
        self.trees = BoostedTrees().fit(np.array([features(t, s) for t, s, _ in train]), np.array([v for *_, v in train], float))
        p, y, kinds = self.trees.probability(np.array([features(t, s) for t, s, _ in held])), np.array([v for *_, v in held], float), np.array([s[0] for _, s, _ in held])
        self.held_out_accuracy = float(((p > 0.5) == (y > 0.5)).mean())
        self.thresholds = {k: max(0.5, threshold_for(p[kinds == k], y[kinds == k], precision)) for k in KINDS if (kinds == k).any()}

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans and all spans, each by start, then kind."""
        base = base_spans(text)
        proposed = candidates(text)
        if not proposed:
            return base, base
        taken = covered(base)
        ends = [b for _, b in taken]
        proposed = [s for s in dict.fromkeys(proposed) if (k := bisect_right(ends, s[1])) == len(taken) or taken[k][0] >= s[2]]
        if not proposed:
            return base, base
        p = self.trees.probability(np.array([features(text, s) for s in proposed]))
        added: list[Span] = []
        for score, s in sorted(zip(-p, proposed), key=lambda t: (t[0], t[1][1], -t[1][2], t[1][0])):
            if -score >= self.thresholds.get(s[0], 2.0):
                added.append(s)
        chosen = _disjoint(added)
        return base, sorted(base + chosen, key=lambda s: (s[1], KINDS.index(s[0])))


def _disjoint(ordered: list[Span]) -> list[Span]:
    """Of spans from best to worst, those that overlap no better one."""
    taken: list[tuple[int, int]] = []
    out = []
    for kind, a, b in ordered:
        k = bisect_left(taken, (a, b))
        if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
            continue
        insort(taken, (a, b))
        out.append((kind, a, b))
    return out


_model: list[PiiModel] = []


def model() -> PiiModel:
    """The model of this process, trained on first use; the same everywhere."""
    if not _model:
        _model.append(PiiModel())
    return _model[0]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced together."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redacted: bool = False) -> DataFrame:
    """Columns `keep`, base_spans, spans (arrays of kind, start, end) and, if asked for, the redacted text."""
    own = [c for c in keep if c not in ("base_spans", "spans", "redacted")]
    source = docs.select(F.col(text).cast("string").alias("_text"), *own)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    names = [*own, "base_spans", "spans"] + ["redacted"] * redacted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = model().spans
        for batch in slices(batches, 1000):
            texts = batch.column(0).to_pylist()
            got = [find(t or "") for t in texts]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in g[k]] for g in got], _SPANS_ARROW) for k in (0, 1)]
            if redacted:
                cols.append(pa.array([t if t is None else redact(t, g[1]) for t, g in zip(texts, got)], pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), *cols], names)

    return source.mapInArrow(run, ", ".join([*kinds, f"base_spans {_SPANS}, spans {_SPANS}"] + ["redacted string"] * redacted))
