"""Personal data: base patterns plus a semi-Markov conditional random field.

The base patterns find e-mail addresses, IPv4 addresses, payment cards and international
phone numbers. The field looks at regions of text around digits, ``@`` and its spellings
(``(at)``, ``[at]``), cut into atoms (runs of ASCII letters or digits, single other
characters). Candidate segments are runs of at most ``LONGEST`` atoms and ``MOST``
characters; features of the whole span (its shape, number of digits, check digit, brackets,
what stands beside it) score each segment under each kind, and a dynamic program over the
atoms chooses borders and kinds jointly. Its spans are added where they overlap no base span;
base spans stay as they are. So numbers written without a country code, cards parted by dots
and spelled-out addresses are found, which the base patterns miss.

The field is trained here, by gradient steps on its log-likelihood: on ``made`` generated
regions and, optionally, on regions of at most ``sample`` documents labelled by the base
patterns. Both bounds are parameters; its size is fixed by its feature templates.

Defined cases: null text is empty and has no spans; repeated rows each get their spans; an
empty table gives no rows and the field still comes from the generated regions; other
columns are untouched. Work per document is linear in its length, whatever its words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Bounds of an entity: atoms, characters (an address has at most 254).
LONGEST, MOST = 18, 260

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: From the first digit of a run only: where that fails, later ones of the same run do too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]", re.S)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]|\(at\)|\[at\]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i & 1:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base patterns, ordered."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- the field ---------------------------------------------------------------------------


def regions(text: str):
    """(start, end) of maximal runs of words with a mark, one space apart; also the word after a spelled-out ``at`` and ``dot``."""
    start = end = None
    for m in _WORD.finditer(text):
        a, b = m.span()
        near = end is not None and a == end + 1 and text[end] == " "
        if _MARK.search(text, a, b) or near and _JOINS.search(text, max(start, end - 5), end) or near and _JOINS.fullmatch(text, a, b):
            if not near:
                if start is not None:
                    yield start, min(len(text), end + 1) if text[end : end + 1] == " " else end
                start = a
                if _JOINS.match(text, a, b):  # a name before a spelled-out at
                    start = _name_before(text, a)
            end = b
        elif not near and start is not None:
            yield start, end + 1 if text[end : end + 1] == " " else end
            start = end = None
        elif start is not None and not _MARK.search(text, a, b):
            yield start, end + 1
            start = end = None
    if start is not None:
        yield start, end + 1 if text[end : end + 1] == " " else end


#: Spellings of ``@`` and of the dot, as words of their own.
_JOINS = re.compile(r"\(at\)|\[at\]|\(dot\)|\[dot\]")


def _name_before(text: str, at: int) -> int:
    """Start of the word before ``at``, if one space parts them and it could be a name."""
    i = at - 1
    if i < 1 or text[i] != " ":
        return at
    start = i
    while start > 0 and i - start <= 64 and text[start - 1] in _LOCAL:
        start -= 1
    return start if 0 < i - start <= 64 else at


def atoms(text: str, start: int, end: int) -> list[int]:
    """Borders of the atoms, first and last included."""
    return [start, *(m.end() for m in _ATOM.finditer(text, start, end))]


def shape(span: str) -> str:
    return re.sub(r"a+", "a", re.sub(r"9+", "9", re.sub(r"[A-Za-z]", "a", re.sub(r"[0-9]", "9", span))))


_EACH, _LETTERS = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]+")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PLAIN = re.compile(r"[A-Za-z0-9.@+() %_-]+")
_PARTED = re.compile(r"[0-9 .-]+")
_FOURS = re.compile(r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}")
_MORE, _PRIOR = re.compile(r"[ .-]?[0-9]"), re.compile(r"[0-9][ .-]?$|[+(]$")


def features(text: str, start: int, end: int) -> list[str] | None:
    """Whole-span features; None if the span can't be an entity (no ``@``, few digits, or too long)."""
    if end - start > MOST or text[start] in " .,;:)]" or text[end - 1] in " (+-.,;:[":
        return None
    span = text[start:end]
    spelled = "at)" in span or "at]" in span
    digits = "".join(c for c in span if "0" <= c <= "9")
    if not (len(digits) >= 7 or len(digits) >= 4 and span.count(".") >= 3 or ("@" in span or spelled) and ("." in span or "dot" in span)):
        return None
    before, after = text[start - 1 : start], text[end : end + 1]
    parts = span.split(".")
    n = len(digits)
    f = [
        "bias", f"n{n if n < 20 else 20}", f"at{span.count('@')}", f"dots{min(4, len(parts) - 1)}",
        f"alpha{any(c.isalpha() for c in span)}", f"paren{('(' in span) + (')' in span)}", f"plus{span[0] == '+'}",
        f"glued{before.isalnum() or before in ('+', '@', '_')}{after.isalnum() or after in ('@', '_')}",
        f"more{bool(_MORE.match(text[end : end + 2]))}", f"prior{bool(_PRIOR.search(text[max(0, start - 2) : start]))}",
        f"space{' ' in span}", f"odd{not _PLAIN.fullmatch(span)}",
    ]
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        f.append(f"octets{all(len(p) < 9 and int(p) <= 255 for p in parts)}")
    if 13 <= n <= 19 and _PARTED.fullmatch(span):
        f.append(f"luhn{luhn(digits)}{'.' in span}")
    if _FOURS.fullmatch(span):
        f.append(f"fours{luhn(digits)}")
    if _ADDRESS.fullmatch(span):
        f.append("address")
    if spelled:
        f.append(f"spelled{bool(_SPELLED.fullmatch(span))}{text[end : end + 1] == '.' and text[end + 1 : end + 2].isalpha()}{bool(re.match(r' ?[(\[]dot', text[end : end + 6]))}")
    if len(span) <= 40:
        f.append("s:" + shape(span))
    if n and len(span) <= 24:
        f.append("g:" + _EACH.sub("9", _LETTERS.sub("a", span)))
    return f


def _from(text: str, cuts: list[int], i: int):
    """Candidate segments (end index, features) that begin at atom ``i``."""
    last = min(i + LONGEST, len(cuts) - 1)
    most = min(cuts[last], cuts[i] + MOST)
    if text[cuts[i]] in " .,;:)]" or not _MARK.search(text, cuts[i], most):
        return
    for j in range(i + 1, last + 1):
        if cuts[j] > most:
            break
        f = features(text, cuts[i], cuts[j])
        if f:
            yield j, f


def lattice(text: str, start: int, end: int):
    """Borders, and for each atom index the candidate segments (end index, features) there."""
    cuts = atoms(text, start, end)
    return cuts, [list(_from(text, cuts, i)) for i in range(len(cuts) - 1)]


def _scores(w: dict, found):
    return [[(j, k, sum(w.get((k, x), 0.0) for x in f), f) for j, f in row for k in range(len(KINDS))] for row in found]


def decode(w: dict, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """Best segmentation of a region; atoms outside entities score 0 each.

    Candidates are scored as the program comes to them and not kept.
    """
    cuts = atoms(text, start, end)
    n = len(cuts) - 1
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for i in range(n):
        if best[i] > best[i + 1]:
            best[i + 1], back[i + 1] = best[i], (i, None)
        for j, f in _from(text, cuts, i):
            for k in range(len(KINDS)):
                s = best[i] + sum(w.get((k, x), 0.0) for x in f)
                if s > best[j]:
                    best[j], back[j] = s, (i, k)
    out, at = [], n
    while at:
        i, k = back[at]
        if k is not None:
            out.append((cuts[i], k, cuts[at]))
        at = i
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def step(w: dict, cuts, found, gold: set[tuple[int, int, int]], rate: float) -> None:
    """One gradient step on the log-likelihood of a region (forward-backward over segments)."""
    n = len(cuts) - 1
    scored = _scores(w, found)
    fwd, bwd = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i in range(n):
        fwd[i + 1] = _log_add(fwd[i + 1], fwd[i])
        for j, _, s, _ in scored[i]:
            fwd[j] = _log_add(fwd[j], fwd[i] + s)
    for i in reversed(range(n)):
        bwd[i] = bwd[i + 1]
        for j, _, s, _ in scored[i]:
            bwd[i] = _log_add(bwd[i], bwd[j] + s)
    for i in range(n):
        for j, k, s, f in scored[i]:
            g = ((i, k, j) in gold) - math.exp(min(0.0, fwd[i] + s + bwd[j] - fwd[n]))
            if abs(g) > 1e-4:
                for x in f:
                    w[(k, x)] = w.get((k, x), 0.0) + rate * g


def _made(rng: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    """A generated region with its gold spans."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    def card():
        n = rng.choice((15, 16, 16, 16, 19)) - 1
        s = d(n)
        s += next(c for c in "0123456789" if luhn(s + c))
        return s if rng.random() < 0.4 or len(s) != 16 else rng.choice(" -..").join(s[i : i + 4] for i in range(0, 16, 4))

    def wrong():
        s = d(16)
        return d(17) if luhn(s) else s

    def phone():
        c = rng.choice(("+1", "+44", "+49", "+33", ""))
        sep = rng.choice(" -.")
        return rng.choice((f"{c} ({d(3)}) {d(3)}-{d(4)}", f"{c}{sep}{d(3)}{sep}{d(3)}{sep}{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}")).strip(" .-")

    def spelled():
        at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("[at]", ".")))
        gap = rng.choice(("", " "))
        dot = f"{gap}{dot}{gap}" if dot != "." else dot
        name = f"{word()}{rng.choice(('', '.', '_'))}{rng.choice((word(), d(2)))}"
        return f"{name}{gap}{at}{gap}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"

    makers = (
        (0, spelled), (0, lambda: f"{word()}{rng.choice(('', '.', '_', '+'))}{rng.choice((word(), d(2)))}@{word()}{rng.choice(('', d(1)))}.{rng.choice(('', word() + '.'))}{rng.choice(('com', 'org', 'net', 'de'))}"),
        (1, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))), (2, card), (3, phone),
        (None, wrong), (None, lambda: d(rng.randint(1, 12))), (None, lambda: f"{d(4)}-{d(2)}-{d(2)}"), (None, lambda: f"{d(1)}.{d(1)}.{d(2)}"),
        (None, lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4))), (None, lambda: f"{d(2)}:{d(2)}:{d(2)}"),
        (None, lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((12, 32, 40))))), (None, lambda: f"{word()}{d(3)}"), (None, lambda: f"@{word()}"),
        (None, lambda: f"{d(4)} {d(4)}"), (None, lambda: f"{d(3)}.{d(2)}"),
        (None, lambda: f"{word()} (at) {d(2)}"), (None, lambda: f"{d(4)}.{d(4)}.{d(4)}"), (None, lambda: f"{d(3)} {word()} {d(4)}"),
    )
    text, spans = "", set()
    for _ in range(rng.randint(1, 3)):
        kind, make = rng.choice(makers[:5] if rng.random() < 0.5 else makers)
        s = make()
        text += rng.choice(("", "", '"', "(", "#"))
        if kind is not None:
            spans.add((len(text), kind, len(text) + len(s)))
        text += s + rng.choice(("", "", "", ",", ".", "%%%", '"', "###", ")")) + " "
    return text, spans


def train(texts: list[str] = (), made: int = 900, rounds: int = 4, seed: int = 7) -> dict:
    """Weights by (kind, feature); from generated regions and regions of ``texts``."""
    rng = random.Random(seed)
    data = []
    for text, spans in [_made(rng) for _ in range(made)] + [(t, set(base_spans(t))) for t in texts]:
        for a, b in regions(text):
            cuts, found = lattice(text, a, b)
            at = {c: i for i, c in enumerate(cuts)}
            gold = {(at[s], k, at[e]) for s, k, e in spans if s in at and e in at}
            if any(found):
                data.append((cuts, found, gold))
    w: dict = {}
    for r in range(rounds):
        rng.shuffle(data)
        for cuts, found, gold in data:
            step(w, cuts, found, gold, 0.25 / (1 + r))
    return w


def spans(w: dict, text: str) -> list[tuple[int, int, int]]:
    """Base spans and, where they leave room, the field's."""
    base = base_spans(text)
    if not _MARK.search(text):
        return base
    out, k = list(base), 0
    for a, b in regions(text):
        for s in decode(w, text, a, b):
            while k < len(base) and base[k][2] <= s[0] and (k + 1 == len(base) or base[k + 1][0] <= s[0]):
                k += 1
            if not any(x[0] < s[2] and s[0] < x[2] for x in base[max(0, k - 2) : k + 4]):
                out.append(s)
    return sorted(out)


def mask(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets."""
    out, at = [], 0
    for start, kind, end in found:
        if end > at:
            if start >= at:
                out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, sample: int = 200) -> dict:
    """Train with regions of at most ``sample`` documents (smallest hashes, texts under 20,000 characters)."""
    picked = (
        docs.filter(F.col("text").rlike("[0-9@]") & (F.length("text") < 20000))
        .select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample)
    )
    return train([r["text"] for r in picked.collect()])


def find(docs: DataFrame, w: dict) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base spans, all spans as kind:start:end, text masked."""
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                t = text.as_py() or ""
                base = base_spans(t)
                every = spans(shared.value, t)
                said = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x)
                rows.append((*(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(said(base).encode()).hexdigest(), said(every), mask(t, every)))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"],
            )

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def redact(docs: DataFrame, w: dict) -> DataFrame:
    """All rows and columns of ``docs`` with personal data masked in text, and n_chars to match."""
    shared = docs.sparkSession.sparkContext.broadcast(w)
    names = docs.columns

    def run(batches):
        for batch in batches:
            at = names.index("text")
            texts = [None if t is None else mask(t, spans(shared.value, t)) for t in batch.column(at).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def op10_semi_markov_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs, fit(docs)).drop("masked")
