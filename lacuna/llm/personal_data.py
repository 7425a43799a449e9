"""Operator 2: personal data by boosted candidate classification.

Base spans come from fixed patterns with checks.  High-recall generators propose further, overlapping
spans (spelled-out addresses, numbers without a country code, odd separators); boosted trees score each by its format
and context, scores are calibrated, and a threshold per kind, set for high precision, selects what is added.  Of
overlapping additions the likelier stays; base spans always stay.

No labelled personal data is at hand, so the trees learn from examples that a seeded generator writes (values and
look-alikes in context), not from the corpus.  Examples come from templates; calibration and thresholds use scores that
trees gave to templates they had not seen, and report() gives precision and recall on these.

Null text counts as empty and has no span.  Patterns run over whole texts and candidates are scored in batches, in time
and memory linear in the text; proposed addresses have at most 64 characters before the @ and 63 a label, as
addresses have (base patterns have no limit).  Repeated rows are judged alike; extra columns are ignored; an empty table
gives an empty result.  Places are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm.boosting import Boosted, platt
from lacuna.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match never starts inside a run of digits, which the look-behind says at once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    """Leftmost matches found from each @, whose left run of allowed characters is the local part."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", m.start(), m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then start."""
    out = _emails(text)
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# --- candidates -----------------------------------------------------------------------------

_AT_SIGN = r"(?: ?[\[({<] ?(?:at|AT) ?[\])}>] ?| (?:at|AT) |_at_| ?@ ?)"
_DOT_SIGN = r"(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |_dot_|\.)"
_CANDIDATES = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?=(" + _AT_SIGN + r"[A-Za-z0-9-]{1,63}(?:" + _DOT_SIGN + r"[A-Za-z0-9-]{1,63}){1,7}))"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\. ?|\[dot\]| dot )[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{2,6}){2,4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9.+-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,3}\(?[0-9]{2,8}\)?){1,5}(?![0-9])|(?<![0-9])[0-9]{9,15}(?![0-9])"),
}
_AT = re.compile(r"[\[({<] ?at ?[\])}>]| at |_at_|@", re.I)
_CUES = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|from", re.I),
    "card": re.compile(r"card|visa|credit|pay|master|amex", re.I),
    "phone": re.compile(r"tel|phone|call|mobile|fax|cell|whatsapp|dial", re.I),
}
_AGAINST = re.compile(r"version|order|isbn|serial|part|ref|item|date|total|price|build|page|fig|token|key|hash|id\b", re.I)


#: Common endings of host names.
_ENDINGS = set("com org net edu gov io de fr uk es it nl pl eu us ca au ch at info biz".split())


def candidates(text: str) -> list[Span]:
    out: list[Span] = []
    if _AT.search(text):
        # what follows the local part is looked at only, so an address may begin inside another's
        out += [("email", m.start(), m.end(1)) for m in _CANDIDATES["email"].finditer(text)]
    if _DIGIT.search(text):
        for kind in KINDS[1:]:
            out += [(kind, m.start(), m.end()) for m in _CANDIDATES[kind].finditer(text) if kind != "phone" or 7 <= len(_digits(m[0])) <= 15]
    return out


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 12]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    seps = re.findall(r"[^0-9A-Za-z]+", s)
    prev, nxt = before[-1:], after[:1]
    return [
        *[float(kind == k) for k in KINDS],
        len(s),
        len(d),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        float(len(set(map(len, groups))) == 1),
        len(set(seps)),
        float(luhn(d)) if d else 0.0,
        float(all(int(g) <= 255 for g in groups)) if groups and len(d) < 40 else 0.0,
        float(s.startswith("(") or "(" in s),
        float("@" in s),
        float("dot" in s),
        float("[" in s or "(at" in s or "{" in s),
        float(" at " in s),
        float(" dot " in s),
        len(re.split(r" ?@ ?|[\[({<] ?at ?[\])}>]| at |_at_", s, maxsplit=1)[0]) if kind == "email" else 0.0,
        float(bool(re.match(r"[A-Za-z]+[._][A-Za-z]+|[A-Za-z]+[0-9]+", s))),
        s.count("."),
        float(s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].strip("])}>").lower() in _ENDINGS),
        float(len(d) in (9, 10, 11, 12)),
        float(d[:2] == "00"),
        float("." in s),
        float("-" in s),
        float("/" in s),
        float(" " in s),
        len(set(d)) / max(1, len(d)),
        float(d[:1] == "0"),
        float(d[:1] in ("3", "4", "5", "6")),
        float(len(groups) >= 2 and [len(g) for g in groups[-2:]] == [3, 4]),
        float(len(s.rsplit(".", 1)[-1].rsplit(" ", 1)[-1]) in (2, 3) and s[-1:].isalpha()),
        float(prev.isalnum()),
        float(nxt.isalnum()),
        float(prev != "" and prev in "\"'=#$%&/_-.:"),
        float(nxt != "" and nxt in "\"'=#$%&/_-"),
        float(bool(_CUES[kind].search(before))),
        float(bool(_AGAINST.search(before))),
        sum(c.isdigit() for c in before + after) / max(1, len(before + after)),
        float(bool(re.match(r"(19|20)[0-9]{2}\b", s) or re.search(r"\b(19|20)[0-9]{2}$", s))),
    ]


# --- training examples ----------------------------------------------------------------------

_WORDS = "the of and report from mara entre para niche taler vion sure older bond pint rale mente liste oder nach home look market station school noon".split()
_NAMES = "john mary anna peter lena omar ines kai rosa tom ada liu emil nora paul eva".split()
_FAMILY = "smith jones meyer garcia rossi dubois novak lind khan okafor weber silva brown moreau".split()
_SITES = "gmail example mail corp company uni hotmail post web firm shop cloud".split()
_CUE_WORDS = {"email": ["email", "mail me at", "contact", "e-mail:", "write to", "reach me:"], "ip": ["ip", "server", "login from", "host", "ip address"], "card": ["card", "visa", "credit card no", "pay with"], "phone": ["tel", "call", "phone", "mobile", "tel.", "fax", "dial"]}
_OTHER_CUES = ["order", "version", "ISBN", "serial", "ref", "total", "build", "item", "date", "token =", "page", "invoice"]


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _valid_card(r: random.Random, n: int = 16) -> str:
    d = r.choice("3456") + _number(r, n - 2)
    return next(d + c for c in "0123456789" if luhn(d + c))


def _grouped(d: str, sizes, sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(d[at : at + n])
        at += n
    return sep.join(x for x in [*out, d[at:]] if x)


def _local(r: random.Random) -> str:
    a, b = r.choice(_NAMES), r.choice(_FAMILY)
    return r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}{b}", f"{a[0]}{b}", f"{a[0]}.{b}", f"{a}{_number(r, r.randint(1, 4))}", f"{b}.{_number(r, 2)}", a, "info", "sales", "support"])


def _host(r: random.Random, dot: str) -> str:
    labels = [r.choice(_SITES) + r.choice(["", "", str(r.randint(1, 9))]), *([r.choice(_SITES)] if r.random() < 0.3 else []), r.choice(["com", "com", "org", "net", "de", "fr", "co.uk".replace(".", dot), "io"])]
    return dot.join(labels)


def _date(r: random.Random) -> tuple[int, int, int]:
    return r.randint(1900, 2030), r.randint(1, 12), r.randint(1, 28)


def _email(at: str, dot: str):
    return lambda r: _local(r) + at + _host(r, dot)


#: What is personal data: by kind, templates that write a value.
GOOD = {
    "email": [_email(*x) for x in ((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("@ ", "."), (" @ ", "."), (" (at) ", " (dot) "), ("{at}", "."), (" AT ", " DOT "), ("_at_", "_dot_"), ("(at)", "(dot)"))],
    "ip": [lambda r, s=s: s.join(str(r.randint(1, 255)) for _ in range(4)) for s in ("[.]", "(.)", " . ", "[dot]", " dot ")],
    "card": [
        *(lambda r, s=s: _grouped(_valid_card(r), (4, 4, 4), s) for s in ("  ", ".", "_", "/", "- ")),
        lambda r: _grouped(_valid_card(r, 15), (4, 6), "."),
        lambda r: _grouped(_valid_card(r, 15), (4, 6), "/"),
    ],
    "phone": [
        lambda r: f"({_number(r, 3)}) {_number(r, 3)}-{_number(r, 4)}",
        lambda r: _grouped(_number(r, 10), (3, 3), "-"),
        lambda r: _grouped(_number(r, 10), (3, 3), "."),
        lambda r: f"00{r.randint(1, 99)} {_number(r, 3)} {_number(r, 3)} {_number(r, 4)}",
        lambda r: f"({_number(r, 3)}) {_number(r, 3)} {_number(r, 4)}",
        lambda r: "0" + _grouped(_number(r, 9), (1, 2, 2, 2), " "),
        lambda r: f"0{_number(r, 2)} {_number(r, 4)} {_number(r, 4)}",
        lambda r: f"00{r.randint(20, 99)} {_number(r, 2)} {_number(r, r.randint(6, 7))}",
        lambda r: f"0{_number(r, 4)} {_number(r, 6)}",
        lambda r: f"0{_number(r, 2)}/{_number(r, 7)}",
        lambda r: f"(0{_number(r, 2)}) {_number(r, 4)} {_number(r, 4)}",
        lambda r: f"0{_number(r, 3)}-{_number(r, 6)}",
    ],
}
#: What looks like it and is not.
LIKE = {
    "email": [
        lambda r: f"{r.choice(_WORDS)} at {r.choice(_WORDS)}.{r.choice(_WORDS)}",
        lambda r: f"{r.choice(_WORDS)} at {r.choice(_WORDS)} dot {r.choice(_WORDS)}{r.choice(_WORDS)}",
        lambda r: f"{r.choice(_WORDS)} at {_number(r, 1)}.{_number(r, 2)}",
        lambda r: f"{r.choice(_WORDS)} at {r.choice(_WORDS)}.{r.choice(_WORDS).title()}",
        lambda r: f"{r.choice(_WORDS)} at {_host(r, '.')}",
        lambda r: f"{r.choice(_WORDS)} at www.{_host(r, '.')}",
        lambda r: f"{r.choice(_WORDS)} at the dot {r.choice(_WORDS)}",
        lambda r: f"{r.choice(_WORDS)} @ {r.choice(_WORDS)}.{r.choice(_WORDS)}",
    ],
    "ip": [*(lambda r, s=s: s.join(str(r.randint(256 * (i == 1), 999)) for i in range(4)) for s in (" . ", ". ", " .")), lambda r: ". ".join(str(r.randint(1, 30)) for _ in range(4)), lambda r: " .".join(str(r.randint(1, 99)) for _ in range(4))],
    "card": [
        lambda r: _wrong(_number(r, r.choice([13, 14, 15, 16, 16, 17, 19]))),
        *(lambda r, s=s: _wrong(_grouped(_number(r, r.choice([14, 15, 16, 16])), (4, 4, 4), s)) for s in ("/", ".", "_", "- ", "  ")),
        lambda r: f"{_date(r)[0]}-{_number(r, 4)}-{_number(r, 4)}-{_number(r, 3)}",
    ],
    "phone": [
        lambda r: "{}-{:02d}-{:02d}".format(*_date(r)),
        lambda r: "{2:02d}/{1:02d}/{0}".format(*_date(r)),
        lambda r: "{2:02d}.{1:02d}.{0}".format(*_date(r)),
        lambda r: "{0}-{1:02d}-{2:02d} {3:02d}".format(*_date(r), r.randint(0, 23)),
        lambda r: _number(r, r.randint(9, 15)),
        lambda r: f"{r.choice('123456789')}{_number(r, 2)} {_number(r, 2)} {_number(r, 5)}",
        lambda r: f"97{r.choice('89')}-{_number(r, 1)}{_number(r, 1)}-{_number(r, 4)}-{_number(r, 3)}",
        lambda r: f"{r.randint(1, 30)}.{r.randint(10, 30)}.{_number(r, 4)}",
        lambda r: f"{r.choice('123456789')}{_number(r, 3)}/{_number(r, 2)}/{_number(r, 3)}",
        lambda r: " ".join(str(r.randint(10, 999)) for _ in range(r.randint(3, 5))),
        lambda r: f"{r.choice('123456789')}{_number(r, 1)}.{_number(r, 3)}.{_number(r, 3)}",
        lambda r: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}",
    ],
}


def _wrong(card: str) -> str:
    """Digits that fail the check."""
    return card[:-1] + str((int(card[-1]) + 1) % 10) if luhn(_digits(card)) else card


def _example(r: random.Random) -> tuple[str, str, int, int, bool, tuple]:
    """(text, kind, start, end, whether it is personal data, template)."""
    kind, good = r.choice(KINDS), r.random() < 0.5
    templates = (GOOD if good else LIKE)[kind]
    which = r.randrange(len(templates))
    value = templates[which](r)
    word = lambda: r.choice(_WORDS)
    cue = ""
    if r.random() < (0.6 if good else 0.1):
        cue = r.choice(_CUE_WORDS[kind]) + r.choice([" ", ": "])
    elif not good and r.random() < 0.5 or r.random() < 0.03:
        cue = r.choice(_OTHER_CUES) + r.choice([" ", ": ", " \"", " #"])
    left = " ".join(word() for _ in range(r.randint(0, 6)))
    left = f"{left} {cue}" if left else cue
    if kind == "email" and left and not cue:
        left = left[:-1] + r.choice([", ", ": ", " "])
    right = r.choice(["", " ", ". ", ", ", "\n"]) + " ".join(word() for _ in range(r.randint(0, 5)))
    return left + value + right, kind, len(left), len(left) + len(value), good, (kind, good, which)


def _sample(examples: int, seed: int):
    """Features, labels, kinds and templates of the candidates that touch the values of written examples."""
    r = random.Random(seed)
    rows = []
    for _ in range(examples):
        text, kind, a, b, good, template = _example(r)
        rows += [(describe(text, s), good and s[1:] == (a, b), kind, template) for s in candidates(text) if s[0] == kind and s[1] < b and a < s[2]]
    x, y, kinds, templates = zip(*rows, strict=True)
    return np.array(x, float), np.array(y, float), np.array(kinds), list(templates)


@functools.lru_cache(maxsize=2)
def _fitted(examples: int, seed: int, precision: float, folds: int):
    x, y, kinds, templates = _sample(examples, seed)
    of = {t: i % folds for i, t in enumerate(sorted(set(templates)))}
    fold = np.array([of[t] for t in templates])
    margin = np.zeros(len(y))
    for f in range(folds):
        margin[fold == f] = Boosted().fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    trees = Boosted().fit(x, y)
    trees.platt = platt(margin, y.astype(bool))
    a, b = trees.platt
    p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
    limits, seen = {}, {}
    for k in KINDS:
        pk, yk = p[kinds == k], y[kinds == k]
        limits[k] = next((c for c in np.linspace(0.5, 0.99, 50) if yk[pk >= c].sum() >= precision * max(1, (pk >= c).sum())), 1.1)
        hit = pk >= limits[k]
        seen[k] = (float(yk[hit].mean()) if hit.any() else 1.0, float(hit[yk > 0].mean()))
    return trees, limits, seen


def model(examples: int = 5000, seed: int = 5, precision: float = 0.98, folds: int = 3) -> tuple[Boosted, dict[str, float]]:
    """Trees, and per kind the least calibrated score with that precision on templates that the trees had not seen."""
    return _fitted(examples, seed, precision, folds)[:2]


def report(examples: int = 5000, seed: int = 5, precision: float = 0.98, folds: int = 3) -> dict[str, tuple[float, float]]:
    """Per kind (precision, recall of the candidates) on templates that the trees had not seen."""
    return _fitted(examples, seed, precision, folds)[2]


def find(texts: list[str], learned=None, at_once: int = 4096) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, each by kind as listed, then start."""
    trees, limits = learned or model()
    out = []
    proposals: list[tuple[int, Span]] = []
    covered = [bytearray(len(t)) for t in texts]  # places that have a span already

    def take(i: int, a: int, b: int) -> None:
        covered[i][a:b] = b"\1" * (b - a)

    for i, t in enumerate(texts):
        base = base_spans(t)
        out.append((base, list(base)))
        for _, a, b in base:
            take(i, a, b)
        proposals += [(i, s) for s in candidates(t) if covered[i].find(1, s[1], s[2]) < 0]
    p = np.zeros(len(proposals))
    for s in range(0, len(proposals), at_once):
        p[s : s + at_once] = trees.probability(np.array([describe(texts[i], span) for i, span in proposals[s : s + at_once]], float))
    for k in np.argsort(-p, kind="stable"):
        i, span = proposals[k]
        if p[k] >= limits[span[0]] and covered[i].find(1, span[1], span[2]) < 0:
            take(i, span[1], span[2])
            out[i][1].append(span)
    return [(base, sorted(both, key=lambda s: (KINDS.index(s[0]), s[1]))) for base, both in out]


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
        else:
            at = max(at, b)
    return "".join(out) + text[at:]


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone: base spans; base_sha256; spans: all; n_added)."""
    learned = model()
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            texts = [t or "" for t in b.column(1).to_pylist()]
            for s in range(0, len(texts), 256):
                for base, both in find(texts[s : s + 256], learned):
                    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                    values = [*counts, hashlib.sha256(render(base).encode()).hexdigest(), render(both), len(both) - len(base)]
                    for c, v in zip(cols, values, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            arrays = [b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")
