"""Personal data by fixed patterns and a semi-Markov conditional random field.

The patterns (e-mail, IPv4, card, international phone) are exact.  The field looks at the
stretches around digits and '@': tokens are grouped into segments of at most ``LONGEST``
tokens and ``GAPS`` gaps of white space, a whole segment is scored by features of its text, its
neighbours and the nearest word of ``CUE_REACH`` tokens before, and dynamic programming picks
the boundaries and types together.  It is trained here, by the gradient of its likelihood, on
sentences drawn from a seeded grammar.  Its spans are added where they do not overlap one of
the patterns.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret", "ssn")
LONGEST = 64
GAPS = 4
CUE_REACH = 8
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CLUSTER = re.compile(r"[0-9][0-9.\x20()-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-zÀ-￿]+|\s+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:] if p.lstrip("0") else "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of the kind) of the fixed patterns, by start and then kind.

    Each kind is matched from the left without overlaps.  A local part cannot hold '@', so
    each '@' is tried once; the other kinds lie inside stretches that start with a digit.
    """
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _CLUSTER.finditer(text):
        a, part = m.start(), m[0]
        if len(part) < 7:
            continue
        for x in _IP.finditer(part):
            if _ip(x[0]):
                found.append((a + x.start(), a + x.end(), 1))
        for x in _CARD.finditer(part):
            digits = x[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((a + x.start(), a + x.end(), 2))
        if a and text[a - 1] == "+":
            phone = part.rstrip(" .()-")
            if len(phone) >= 3 and 10 <= sum(map(str.isdigit, phone)) <= 15:
                found.append((a - 1, a + len(phone), 3))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


# -- the field ---------------------------------------------------------------------------

#: Words before a value that tell its type; fixed values.
_CUES = {"tel": "tel", "phone": "tel", "telefon": "tel", "call": "tel", "fax": "tel", "mobile": "tel", "token": "key", "secret": "key", "key": "key", "password": "key", "apikey": "key", "card": "card", "visa": "card", "ssn": "ssn", "social": "ssn", "mail": "mail", "email": "mail", "ip": "ip", "host": "ip", "version": "ver", "v": "ver", "page": "ver", "iban": "iban", "commit": "ver", "sha": "ver", "order": "ver", "passwd": "key", "credential": "key"}


def _regions(text: str):
    """Ranges of text with some context around digits and '@'."""
    lo = hi = -1
    for m in re.finditer(r"[0-9@][^\s]*", text):
        a, b = max(0, m.start() - 24), min(len(text), m.end() + 24)
        if a <= hi:
            hi = b
        else:
            if hi > lo:
                yield lo, hi
            lo, hi = a, b
    if hi > lo:
        yield lo, hi


def _segments(text: str, tokens: list[tuple[int, int]]):
    """(i, j, features) of the candidate segments: tokens i to j - 1, at most LONGEST."""
    kinds = ["d" if text[a].isdigit() else "s" if text[a].isspace() else "w" if text[a].isalpha() else text[a] for a, _ in tokens]
    for i, k in enumerate(kinds):
        if k not in "dw+(" or (k == "w" and (i and kinds[i - 1] in "dw")):
            continue
        cue = "-"
        for back in range(i - 1, max(-1, i - CUE_REACH), -1):
            if kinds[back] == "w":
                cue = _CUES.get(text[slice(*tokens[back])].lower(), "-")
                break
        words = 0
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            last = kinds[j - 1]
            words += last == "s"
            if words > GAPS or "\n" in text[slice(*tokens[j - 1])]:
                break
            if last not in "dw" or (j < len(kinds) and kinds[j] in "dw" and last in "dw"):
                continue
            s = text[tokens[i][0] : tokens[j - 1][1]]
            digits = re.sub(r"\D", "", s)
            if not digits and "@" not in s:
                continue
            parts = re.split(r"[^0-9A-Za-zÀ-￿]+", s.strip("+("))
            shape = re.sub(r"a+", "a", re.sub(r"[^\W\d]", "a", re.sub(r"\d", "9", s)))
            plain = re.sub(r"[\s()+.-]", "", s)
            numeric = plain.isdigit()
            before = text[tokens[i][0] - 1] if tokens[i][0] else " "
            after = text[tokens[j - 1][1]] if tokens[j - 1][1] < len(text) else " "
            f = [f"n{min(len(digits), 20) if numeric else -1}", f"p{len(parts)}", f"cue{cue}", f"<{before if not before.isalnum() else 'x'}", f">{after if not after.isalnum() else 'x'}"]
            f.append(f"shape{shape}" if len(shape) <= 22 else "long")
            if numeric:
                f.append(f"luhn{len(digits) > 12 and luhn(digits)}{'.' in s}")
                f.append(f"plus{s[0]}" if s[0] in "+(" else "bare")
                if re.fullmatch(r"\d+(\.\d+){3}", s):
                    f.append(f"quad{_ip(s)}")
            elif "@" in s:
                f.append(f"at{s.count('@')}{bool(re.fullmatch(r'[^@s]+@[^@ ]+[.][a-z]+', s.lower()))}{' ' in s}")
            elif plain.isalnum() and len(parts) == 1:
                f.append(f"mixed{min(len(plain) // 8, 5)}{bool(re.fullmatch('[0-9a-f]+', plain.lower()))}")
                f.append(f"quoted{before in QUOTES}{cue}")
            else:
                f.append("other")
                f.append(f"words{words}")
            yield i, j, f


QUOTES = "\"'`"


def _tokens(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, lo, hi)]


def _lse(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def _score(w, f, y: int) -> float:
    return w.get((y, ""), 0.0) + sum(w.get((y, x), 0.0) for x in f)


def best_segments(text: str, lo: int, hi: int, w) -> list[tuple[int, int, int]]:
    """The best segmentation of a region: (start, end, kind) of its segments that are data."""
    tokens = _tokens(text, lo, hi)
    ending = defaultdict(list)
    for i, j, f in _segments(text, tokens):
        y, s = max(((y, _score(w, f, y)) for y in range(len(KINDS))), key=lambda p: p[1])
        if s > 0:
            ending[j].append((i, y, s))
    best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
    for j in range(1, len(tokens) + 1):
        best[j] = best[j - 1]
        for i, y, s in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, y)
    out, j = [], len(tokens)
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, y = back[j]
            out.append((tokens[i][0], tokens[j - 1][1], y))
            j = i
    return out[::-1]


def _sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence of the training grammar and its spans."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "er", "ti", "on", "le", "sch", "ó", "th")) for _ in range(rng.randint(1, 3)))

    def card() -> str:
        x = d(rng.choice((14, 15)))
        x += next(c for c in "0123456789" if luhn(x + c))
        sep = rng.choice(("", "", " ", "-", "."))
        return sep.join(x[k : k + 4] for k in range(0, len(x), 4))

    def phone() -> str:
        a, b, c, e = rng.choice("123456789") + d(rng.randint(0, 1)), d(3), d(3), d(4)
        return rng.choice((f"+{a} ({b}) {c}-{e}", f"+{a} {b} {c} {e}", f"({b}) {c}-{e}", f"{b}-{c}-{e}", f"{b}.{c}.{e}", f"00{a} {b} {c} {e}"))

    def email() -> str:
        a = word().replace("ó", "o") + rng.choice(("", ".", "_")) + d(rng.randint(0, 2))
        b = f"{rng.choice(('mail', 'host', 'example'))}{d(rng.randint(0, 1))}"
        return rng.choice((f"{a}@{b}.example.com", f"{a}@{b}.org", f"{a} @ {b}.com", f"{a}@{b} . com"))

    chars = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    hexed = lambda: chars("0123456789abcdef", rng.choice((32, 40, 64)))
    mixed = lambda: chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3) + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", rng.randint(17, 37)) + d(1)
    secret = lambda: rng.choice((hexed, hexed, mixed))()
    key = lambda: rng.choice(("token", "secret", "key", "password", "apikey", "passwd")) + rng.choice((" = ", "=", ": ", " is ", " ")) + rng.choice(('"', "'", ""))
    iban = lambda: f"{chars('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 2)}{d(2)}" + "".join(f"{sep}{d(4)}" for sep in [rng.choice(("", " "))] * rng.randint(3, 5)) + rng.choice(("", d(2)))
    octet = lambda: str(rng.randint(0, 255))
    makers = [(0, email, ""), (1, lambda: ".".join(octet() for _ in range(4)), ""), (2, card, ""), (3, phone, ""), (4, secret, None), (5, lambda: f"{d(3)}-{d(2)}-{d(4)}", "ssn ")]
    noise = [lambda: d(rng.randint(1, 6)), lambda: f"version {d(1)}.{d(1)}", lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.{d(4)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(3)},{d(3)}.{d(2)}", lambda: d(rng.randint(17, 24)), lambda: f"{word()}{d(2)}", lambda: f"{300 + int(d(2))}.{d(3)}.{d(1)}.{d(2)}", lambda: f"@{word()}", iban, iban, lambda: f"iban {iban()}", lambda: rng.choice(("commit ", "sha ", "order ")) + hexed()]
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
        if rng.random() < 0.65:
            y, make, lead = rng.choice(makers)
            lead = key() if lead is None else lead if lead or rng.random() < 0.7 else rng.choice(("tel ", "card ", "mail ", "ip ", ""))
            value = make()
            text += lead
            spans.append((len(text), len(text) + len(value), y))
            text += value + (lead[-1] if lead and lead[-1] in QUOTES else "")
        else:
            text += rng.choice(noise)()
        text += rng.choice((" ", ". ", ", ", "%%% ", "!! "))
    return text, spans


@functools.lru_cache(maxsize=4)
def train(sentences: int = 1000, passes: int = 4, rate: float = 0.3, seed: int = 5) -> dict:
    """Weights by the gradient of the log-likelihood of the segmentations."""
    rng, w = random.Random(seed), defaultdict(float)
    data = []
    for _ in range(sentences):
        text, spans = _sentence(rng)
        tokens = _tokens(text, 0, len(text))
        gold, rows = set(spans), []
        for i, j, f in _segments(text, tokens):
            rows.append((i, j, f, next((y for y in range(len(KINDS)) if (tokens[i][0], tokens[j - 1][1], y) in gold), -1)))
        data.append((len(tokens), rows))
    for turn in range(passes):
        step = rate / (1 + turn)
        for n, rows in data:
            at, by = defaultdict(list), defaultdict(list)
            scored = [(i, j, f, g, [_score(w, f, y) for y in range(len(KINDS))]) for i, j, f, g in rows]
            for r in scored:
                at[r[1]].append(r)
                by[r[0]].append(r)
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                alpha[j] = _lse([alpha[j - 1], *(alpha[i] + s for i, _, _, _, ss in at.get(j, ()) for s in ss)])
            for i in range(n - 1, -1, -1):
                beta[i] = _lse([beta[i + 1], *(s + beta[j] for _, j, _, _, ss in by.get(i, ()) for s in ss)])
            for i, j, f, g, ss in scored:
                for y, s in enumerate(ss):
                    change = (y == g) - math.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n]))
                    if abs(change) > 0.01:
                        for x in ("", *f):
                            w[y, x] += step * change
    return {k: round(v, 4) for k, v in w.items() if abs(v) > 0.02}


def all_spans(text: str, base: list[tuple[int, int, int]], w) -> list[tuple[int, int, int]]:
    """Base spans and those of the field that overlap none of them, by start and kind."""
    out = list(base)
    for lo, hi in _regions(text):
        near = [s for s in base if s[0] < hi and s[1] > lo]
        for a, b, y in best_segments(text, lo, hi, w):
            if all(b <= s[0] or a >= s[1] for s in near):
                out.append((a, b, y))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[y]}:{a}:{b}" for a, b, y in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans of every row of ``docs``.

    The counts and the digest are of the fixed patterns; ``spans`` lists those and the
    field's, as kind:start:end in code points, and ``n_spans`` counts them.  Of equally good
    segmentations the one with fewer and later segments is taken; very long texts are read
    whole, stretch by stretch.  Null and empty texts have none (counts 0,
    the digest of nothing, an empty list); a null doc_id stays null; repeated rows are all
    returned; other columns are ignored; an empty table gives no rows.
    """
    weights = train()

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(7)]
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                for k in range(4):
                    cols[k].append(sum(1 for s in base if s[2] == k))
                cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans = all_spans(t, base, weights)
                cols[5].append(_joined(spans))
                cols[6].append(len(spans))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, types))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
