"""Personal data by fixed patterns and a linear-chain conditional random field.

Base spans come from patterns with checks (digit counts, Luhn). The random field reads
word shapes and is decoded by Viterbi in NumPy batches. It is trained on a small labelled
table that knows nothing of the patterns: sentences around secrets, identity numbers and
other ways of writing the base kinds, and around numbers that are none of these. Its
spans are added where they touch no base span; base spans always stay.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Shared

#: Fixed order of the kinds that have a pattern, then of those that only the field knows;
#: labels count from 1 in this order, label 0 is none.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "identity")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        n = int(ch)
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches found from their @ signs, so that long words cost no retries."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind and start."""
    text = text or ""
    if not _HINT.search(text):
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def _bucket(n: int) -> int:
    return n if n < 5 else 2 + n.bit_length()


def _shape(word: str) -> list[str]:
    """Names of a word's own features, from all its characters: shape, lengths, character shares, first and last."""
    s = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", "a", word))
    core = s.strip("\"'`.,;:!?#$%&*()[]{}<>")
    short = re.sub(r"(.)\1+", r"\1", core)
    digits, letters = core.count("9"), core.count("a")
    bare = word.strip("\"'`.,;:!?#$%&*()[]{}<>").lower()
    out = [
        "bias", f"shape {short}", f"digits {_bucket(digits)}", f"letters {_bucket(letters)}", f"size {_bucket(len(core))}", f"turns {_bucket(len(short))}",
        f"dots {min(core.count('.'), 5)}", f"colons {min(core.count(':'), 5)}", f"dashes {min(core.count('-'), 5)}", f"at {'@' in core}",
        f"first {s[0]}", f"last {s[-1]}", f"plus {word[0] == '+'}", f"all {digits == len(core)}", f"hex {len(bare) > 0 and not bare.strip('0123456789abcdef')}",
        f"share {8 * digits // max(len(core), 1)}", f"upper {sum(c.isupper() for c in word) * 4 // max(len(word), 1)}",
    ]
    if len(core) <= 20:
        out.append(f"long {core}")
    return out


def _context(word: str, place: str) -> list[str]:
    """Names of the features that a word gives to its neighbour."""
    bare = word.strip("\"'`.,;!?()[]").lower()
    return [f"{place} {bare if not re.search(r'[0-9]', bare) else '9'}"]


def _features(words: list[str]) -> list[list[str]]:
    """Features of every word of a window: its own and those of its two neighbours on each side."""
    out = []
    for i, w in enumerate(words):
        own = _shape(w)
        for d in (-2, -1, 1):
            if 0 <= i + d < len(words):
                own += _context(words[i + d], f"at {d}")
        out.append(own)
    return out


def _candidate_windows(text: str, reach: int = 3):
    """Lists of token spans around every word with a digit or @; all such words are covered."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out, last = [], -1
    for i, (a, b) in enumerate(tokens):
        if _HINT.search(text, a, b):
            lo, hi = max(0, i - reach), min(len(tokens), i + reach + 1)
            if lo <= last and out:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
            last = hi
    return [tokens[a:b] for a, b in out]


def _labels(window, spans) -> list[int]:
    out = []
    for a, b in window:
        hit = [k + 1 for k, x, y in spans if x < b and y > a]
        out.append(hit[0] if hit else 0)
    return out


def viterbi(emit: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """Best label chains of many sequences at once."""
    if not emit:
        return []
    order = sorted(range(len(emit)), key=lambda i: len(emit[i]))
    out: list[np.ndarray] = [None] * len(emit)  # type: ignore[list-item]
    for at in range(0, len(order), 512):
        some = order[at : at + 512]
        n = np.array([len(emit[i]) for i in some])
        length = int(n.max())
        e = np.zeros((len(some), length, step.shape[0]))
        for r, i in enumerate(some):
            e[r, : n[r]] = emit[i]
        best = e[:, 0]
        back = np.zeros((len(some), length, step.shape[0]), np.int8)
        for t in range(1, length):
            s = best[:, :, None] + step[None]
            back[:, t] = s.argmax(1)
            live = (t < n)[:, None]
            best = np.where(live, s.max(1) + e[:, t], best)
        label = best.argmax(1)
        chain = np.zeros((len(some), length), np.int64)
        for t in range(length - 1, -1, -1):
            live = t < n
            chain[live, t] = label[live]
            label = np.where(live, back[np.arange(len(some)), t, label], label)
        for r, i in enumerate(some):
            out[i] = chain[r, : n[r]]
    return out


def _forward_backward(emit: np.ndarray, on: np.ndarray, step: np.ndarray):
    """Label marginals (n, length, labels) and summed pair marginals."""
    e = np.where(on[:, :, None], np.exp(emit - emit.max(2, keepdims=True)), 1.0)
    trans = np.exp(step)
    n, length, k = e.shape
    fwd, back = np.empty_like(e), np.ones_like(e)
    fwd[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, length):
        f = (fwd[:, t - 1] @ trans) * e[:, t]
        fwd[:, t] = np.where(on[:, t, None], f / f.sum(1, keepdims=True), fwd[:, t - 1])
    for t in range(length - 2, -1, -1):
        b = (back[:, t + 1] * e[:, t + 1]) @ trans.T
        back[:, t] = np.where(on[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    p = fwd * back
    p /= p.sum(2, keepdims=True)
    both = fwd[:, :-1, :, None] * trans[None, None] * (e[:, 1:] * back[:, 1:])[:, :, None, :]
    both /= both.sum((2, 3), keepdims=True)
    return p, both[on[:, 1:]].sum(0)


def train(rows: list[tuple[list[list[str]], list[int]]], rounds: int = 60, longest: int = 40, rate: float = 0.2, l2: float = 1e-3) -> dict:
    """Field from (features by word, label by word) sequences: weights by feature, transitions."""
    k = len(ALL_KINDS) + 1
    parts = [(f[a : a + longest], y[a : a + longest]) for f, y in rows for a in range(0, len(y), longest)]
    counts = Counter(x for f, _ in parts for word in f for x in word)
    names = sorted(x for x, n in counts.items() if n > 1)  # seen once, a feature tells nothing of other words
    at = {x: i for i, x in enumerate(names)}
    if not parts:
        return {"features": {}, "w": np.zeros((1, k)), "step": np.zeros((k, k))}
    length, width = max(len(y) for _, y in parts), max(len(w) for f, _ in parts for w in f)
    ids = np.full((len(parts), length, width), len(names))
    gold = np.zeros((len(parts), length), np.int64)
    on = np.zeros((len(parts), length), bool)
    for r, (f, y) in enumerate(parts):
        on[r, : len(y)] = True
        gold[r, : len(y)] = y
        for t, word in enumerate(f):
            known = [at[x] for x in word if x in at]
            ids[r, t, : len(known)] = known
    w, step = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    seen = np.zeros((k, k))
    pair_on = on[:, 1:]
    np.add.at(seen, (gold[:, :-1][pair_on], gold[:, 1:][pair_on]), 1)
    mw, vw, ms, vs = np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)
    flat, n = ids[on], on.sum()
    for r in range(1, rounds + 1):
        p, pairs = _forward_backward(w[ids].sum(2), on, step)
        diff = np.eye(k)[gold[on]] - p[on]
        gw = np.column_stack([np.bincount(flat.ravel(), np.repeat(diff[:, c], width), len(names) + 1) for c in range(k)]) / n - l2 * w / 10
        gs = (seen - pairs) / n - l2 * step
        for g, m, v, x in ((gw, mw, vw, w), (gs, ms, vs, step)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        w[-1] = 0
    return {"features": at, "w": w, "step": step}


def _examples(rng: random.Random):
    """(kind or None, words before, value, words after) of one made-up mention, by rule."""
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    chars = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    name = lambda: chars(low, rng.randint(2, 9))
    host = lambda: f"{name()}{pick(['', digits(1)])}.{pick(['com', 'org', 'net', 'de', 'example.com', 'co.uk'])}"
    key_name = pick(["token", "key", "secret", "password", "api_key", "access_key", "passwd", "auth", "pwd", "apikey", "credential", "bearer", "private_key", "client_secret"])
    sign = pick([["="], [":"], ["is"], [":="], []])
    quoted = lambda v: pick(['"{}"', "'{}'", "{}", '"{}"', '"{}";', '"{}",']).format(v)
    kind = rng.randrange(30)
    if kind < 7:
        value = pick([
            lambda: chars("0123456789abcdef", pick([24, 32, 40, 40, 48, 64])), lambda: chars("0123456789ABCDEF", pick([32, 40])), lambda: chars(low + up + "0123456789", rng.randint(16, 48)),
            lambda: "AKIA" + chars(up + "0123456789", 16), lambda: "sk_live_" + chars(low + up + "0123456789", 24), lambda: "ghp_" + chars(low + up + "0123456789", 36),
            lambda: chars(low + up + "0123456789+/", 42) + "==", lambda: chars(low, 6) + digits(3) + pick("!$#") + chars(up, 2),
        ])()
        return "secret", [*([pick(["the", "export", "set", "my", "const"])] if rng.random() < 0.5 else []), *([key_name, *sign])], quoted(value), []
    if kind == 7:  # key and value in one word
        return "secret", [], f"{key_name}{pick(['=', ':'])}{quoted(chars('0123456789abcdef', pick([32, 40, 64])))}", []
    if kind == 8:
        return "identity", [pick(["ssn", "social", "SSN:", "id"])], f"{digits(3)}-{digits(2)}-{digits(4)}", []
    if kind == 9:
        return "identity", [pick(["iban", "IBAN", "account", "konto"])], chars(up, 2) + digits(rng.randint(16, 22)), []
    if kind == 10:
        return "phone", [pick(["call", "phone", "tel", "Tel.", "fax", "mobile"])], pick([f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)})-{digits(3)}-{digits(4)}", f"0{digits(3)}/{digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]), []
    if kind == 11:
        return "ip", [pick(["address", "host", "from", "ipv6"])], ":".join(chars("0123456789abcdef", 4) for _ in range(8)), []
    if kind < 14:
        return "email", [pick(["mail", "to", "contact", "write", name()])], f"{name()}{pick(['.', '_', '', '-'])}{pick([name(), digits(2)])}@{host()}", []
    if kind == 14:
        return "ip", [pick(["from", "at", "address", name()])], ".".join(str(rng.randint(0, 255)) for _ in range(4)), []
    if kind == 15:
        return "phone", [pick(["call", "phone", name()])], f"+{digits(1)}-{digits(3)}-{digits(3)}-{digits(4)}", []
    # the rest is no personal data: counts, dates, versions, prices, names with digits, sums
    value = pick([
        lambda: digits(rng.randint(1, 5)), lambda: digits(rng.randint(6, 12)), lambda: digits(rng.randint(13, 19)), lambda: f"{digits(1)}.{digits(1)}", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}",
        lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"${digits(2)}.{digits(2)}",
        lambda: f"{digits(2)}%", lambda: f"{digits(2)},{digits(3)}", lambda: f"{digits(2)},{digits(3)},{digits(3)}", lambda: f"{digits(1)}{pick(['st', 'nd', 'rd', 'th'])}", lambda: f"{name()}{digits(2)}", lambda: f"{chars(up, 2)}{digits(2)}",
        lambda: f"{digits(2)}-{digits(2)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"({digits(4)})", lambda: f"{digits(2)}{pick(['km', 'kg', 'ms', 'GB', 'h'])}", lambda: f"v{digits(1)}.{digits(2)}", lambda: f"https://{host()}/{name()}/{digits(4)}",
        lambda: f"{name()}_{digits(2)}.txt", lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"#{digits(4)}", lambda: f"[{digits(2)}]", lambda: f"{digits(1)}.", lambda: f"{digits(3)}x{digits(3)}", lambda: f"@{name()}",
    ])()
    before = pick([[], [pick(["Version", "in", "page", "order", "number", "year", "about", "of", "the", "section", "key", "token", "id", "at", "is", "=", ":"])], [name()]])
    return None, before, value, []


def labelled_table(spark, n: int = 1500, seed: int = 11) -> DataFrame:
    """(text, spans of kind, start, end): ``n`` made-up sentences with labelled mentions, by rule.

    The labels are those of what was written, not of any pattern; half of the mentions are
    numbers and names that are no personal data. The same table in every run.
    """
    rng = random.Random(seed)
    letters = "aeioulnrstdéèüñ"
    rows = []
    for _ in range(n):
        words: list[str] = []
        marks = []
        for _ in range(rng.randint(1, 3)):
            words += ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) + rng.choice(["", "", "", ",", ".", "%%%", "***"]) for _ in range(rng.randint(1, 5))]
            kind, before, value, after = _examples(rng)
            words += before
            if kind:
                marks.append((kind, len(words)))
            words += [value + rng.choice(["", "", "", "", ".", ",", "###", "$$$", "&&&"]), *after]
        words += ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(0, 4))]
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        rows.append((" ".join(words), [(k, starts[i], starts[i] + len(words[i])) for k, i in marks]))
    return spark.createDataFrame(rows, "text string, spans array<struct<kind:string,start:int,end:int>>")


def fit(labelled: DataFrame, most: int = 5000) -> dict:
    """Field from a small labelled table (text, spans of kind, start, end).

    At most ``most`` rows are used, those with the smallest hashes; the labels of a word are
    those of the spans it touches. Texts of any length are used whole.
    """
    rows = []
    for r in labelled.orderBy(F.xxhash64("text"), "text").limit(most).collect():
        spans = [(ALL_KINDS.index(s["kind"]), s["start"], s["end"]) for s in r.spans or []]
        for window in _candidate_windows(r.text or ""):
            rows.append((_features([r.text[a:b] for a, b in window]), _labels(window, spans)))
    return train(rows)


def _trimmed(text: str, kind: int, a: int, b: int) -> tuple[int, int]:
    """A run of words without the marks around it; of an assignment only the value."""
    if kind >= len(KINDS):
        m = re.match(r"[\w-]+[=:]+(?=.)", text[a:b])
        a += m.end() if m else 0
        while a < b and not (text[a].isalnum() or text[a] in "+/_-"):
            a += 1
        while b > a and not (text[b - 1].isalnum() or text[b - 1] in "+/=_-!$"):
            b -= 1
        while b > a and text[b - 1] in "!$" and text[b - 2 : b - 1] in ("!", "$", '"', "'"):
            b -= 1
        return a, b
    while b > a and text[b - 1] in ".,;:!?)#$%&*\"'":
        b -= 1
    return a, b


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and spans, array of (kind, start, end, base), by kind and start.

    Positions are code points, ends exclusive, over the whole text; null counts as
    empty. ``base`` tells pattern spans from those the field adds: runs of words with one
    label that overlap no other span. Other columns are not read; nothing is shuffled.
    """
    shared = Shared(docs.sparkSession, model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo: dict[tuple, np.ndarray] = {}

        def weights(word: str, place: int) -> np.ndarray:
            got = memo.get((word, place))
            if got is None:
                names = _context(word, f"at {place}") if place else _shape(word)
                got = m["w"][[m["features"][x] for x in names if x in m["features"]]].sum(0)
                if len(word) <= 64:
                    if len(memo) > 50_000:
                        memo.clear()
                    memo[word, place] = got
            return got

        def emissions(words: list[str]) -> np.ndarray:
            out = np.array([weights(w, 0) for w in words])
            for d in (-2, -1, 1):
                for i in range(max(0, -d), len(words) - max(0, d)):
                    out[i] = out[i] + weights(words[i + d], d)
            return out

        for part in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = part.column(1).to_pylist()
            spans = [base_spans(t) for t in texts]
            windows, emit = [], []
            for i, t in enumerate(texts):
                if t and m["features"] and _HINT.search(t):
                    for window in _candidate_windows(t):
                        windows.append((i, window))
                        emit.append(emissions([t[a:b] for a, b in window]))
            added: dict[int, list] = {}
            for (i, window), labels in zip(windows, viterbi(emit, m["step"])):
                at = 0
                while at < len(window):
                    end = at + 1
                    if labels[at]:
                        while end < len(window) and labels[end] == labels[at]:
                            end += 1
                        a, b = _trimmed(texts[i], int(labels[at]) - 1, window[at][0], window[end - 1][1])
                        if b > a and not any(x < b and y > a for _, x, y in spans[i]):
                            added.setdefault(i, []).append((int(labels[at]) - 1, a, b))
                    at = end
            out = []
            for i, own in enumerate(spans):
                both = [(*s, True) for s in own] + [(*s, False) for s in added.get(i, [])]
                out.append([{"kind": ALL_KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in sorted(both)])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["id", "spans"])

    schema = f"id {dict(docs.dtypes)[id_col]}, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
