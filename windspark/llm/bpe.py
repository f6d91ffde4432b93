"""Byte-pair encoding and decoding by per-prefix dynamic programming.

For every prefix of a word its encoding has one last token. The automaton of the vocabulary
lists the tokens that are suffixes of the prefix; the one is stored that is compatible with the
last token of what is left of it, where two tokens are compatible if merging their joined text by
rank gives back these two. The stored tokens point back to shorter prefixes, and following
them gives the ids. The time is linear in the text, also for one word of a megabyte.

The vocabularies read here are those with word ends: normal form C, lower case, a text cut into
contractions, letters, single digits and other characters, white space dropped, words as bytes
whose last one carries the end mark.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import MEMO, Codec, Shared, Table, _Automaton

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Fixed by the file format: what a word-end tokenizer cuts a text into.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The contractions of the pattern, without the apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _classes() -> np.ndarray:
    """Class of every code point, by the library's own Unicode tables."""
    from tokenizers import Regex, pre_tokenizers

    known = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        for at in range(0, len(known), 1 << 16):
            for part, _ in cut.pre_tokenize_str("".join(map(chr, known[at : at + (1 << 16)]))):
                out[[ord(c) for c in part]] = kind
    return out


def _unsure() -> np.ndarray:
    """Characters that Python and the library, whose Unicode versions differ, may normalise in two ways."""
    from tokenizers import normalizers

    library, out = normalizers.NFC().normalize_str, []
    for c in map(chr, range(0x110000)):
        kind = unicodedata.category(c)
        if kind == "Cn":
            out.append(c)
        elif kind == "Cs" or "가" <= c <= "힣":
            continue
        elif unicodedata.combining(c):
            for pair in (c + "\u0334", "\u0345" + c):  # the lowest and the highest combining class
                if library(pair) != unicodedata.normalize("NFC", pair):
                    out.append(c)
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            apart = unicodedata.normalize("NFD", c)
            if library(apart) != unicodedata.normalize("NFC", apart) or library(c) != unicodedata.normalize("NFC", c):
                out += [c, *apart]
    return np.unique([ord(c) for c in out])


def load_tokenizer(path: str) -> dict:
    """What encoding needs of a tokenizer file; read on the driver, its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, kinds = spec["model"], [n["type"] for n in spec["normalizer"].get("normalizers", [])]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    if (
        model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["dropout"] or model.get("ignore_merges")
        or kinds != ["NFC", "Replace", "Lowercase"] or split["pattern"] != {"Regex": PATTERN} or spec["decoder"]
        or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    ):
        raise ValueError(f"{path} is not a lower-casing byte-pair vocabulary with word ends")
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {
        "vocab": model["vocab"], "merges": merges, "end": model["end_of_word_suffix"], "normalizer": json.dumps(spec["normalizer"]),
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]}, "classes": _classes(),
        "unsure": _unsure(),
    }


class WordCodec(Codec):
    """Encoder and decoder of one process.

    Words are strings of symbols: character b for byte b, character 256 + b for a last byte.
    The table, its walk and the reading back are those of :class:`pieces.Codec`; what two
    neighbours must fulfil is another matter here, as merges are ranked by pair.
    """

    def __init__(self, spec: dict):
        plain = {c: chr(b) for b, c in enumerate(byte_symbols())}
        end = spec["end"]

        def symbols(token: str) -> str:
            if not token.endswith(end):
                return "".join(plain[c] for c in token)
            body = token[: -len(end)]
            return "".join(plain[c] for c in body[:-1]) + chr(256 + ord(plain[body[-1]]))

        special = set(spec["special"].values())
        self.token = {i: t for t, i in spec["vocab"].items()} | {i: t for t, i in spec["special"].items()}
        self.rank = {(symbols(a), symbols(b)): -k for k, (a, b) in enumerate(spec["merges"])}
        of = {symbols(t): i for t, i in spec["vocab"].items() if i not in special}
        self.name = {i: p for p, i in of.items()}
        self.start = max(self.token) + 1
        self.size = np.zeros(self.start + 1, np.int32)
        for i, p in self.name.items():
            self.size[i] = len(p)
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.automaton = _Automaton({p: i for p, i in of.items() if len(p) == 1 or self.merged(p) == [p]})
        self.pairs = Table(1 << 20, np.int8)
        self.classes = spec["classes"]
        self.unsure = np.zeros(0x110000, bool)
        self.unsure[spec["unsure"]] = True  # where the library's normaliser decides
        self.normalizer = spec["normalizer"]
        self.special = spec["special"]
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _joined(self, parts: list[str], border: int = -1) -> tuple[list[str], int]:
        """``parts`` merged by rank, the leftmost of equals first, until nothing merges or a merge would cross ``border``."""
        rank, none = self.rank, -(1 << 60)
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = max(ranks)
            at = ranks.index(best)
            if best == none or at + 1 == border:
                return parts, border if best == none else -2
            border -= at + 1 < border
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank.get((parts[at], parts[at + 1]), none)
        return parts, border

    def merged(self, text: str) -> list[str]:
        return self._joined(list(text))[0]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        parts, border = self._joined(list(left + right), len(left))
        return len(parts) == 2 and border == 1

    def normal(self, text: str) -> str:
        """Normal form C in lower case, character by character (no final sigma)."""
        if text.isascii():
            return text.lower()
        if self.unsure[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return self._library(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _library(self, text: str) -> str:
        from tokenizers import Tokenizer, models

        if isinstance(self.normalizer, str):
            t = Tokenizer(models.BPE())
            spec = json.loads(t.to_str()) | {"normalizer": json.loads(self.normalizer)}
            self.normalizer = Tokenizer.from_str(json.dumps(spec)).normalizer
        return self.normalizer.normalize_str(text)

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """(number of each word in ``distinct``, distinct words, words before each text and at the end) of normal texts."""
        joined = "\n".join(texts) + "\n"
        raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        points = raw if len(raw) == len(joined) else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[points]
        inside = kind != SPACE
        before = np.empty_like(kind)
        before[0], before[1:] = SPACE, kind[:-1]
        start = inside & ((kind != before) | (kind == NUMBER))
        quote = np.flatnonzero((points[:-1] == ord("'")) & (before[:-1] != OTHER) & (kind[1:] == LETTER))
        if len(quote):
            one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
            short = np.isin(one, [ord(c) for c in SHORT])
            long = np.zeros(len(quote), bool)
            for a, b in LONG:
                long |= (one == ord(a)) & (two == ord(b))
            start[quote[short | long] + 1] = False
            for at in (quote[short] + 2, quote[long] + 3):
                at = at[at < len(points)]
                start[at] |= kind[at] == LETTER
        if points is not raw:
            width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            raw = raw[np.repeat(inside, width)]
            cut = np.cumsum(np.where(inside, width, 0))[start] - width[start]
        else:
            raw = raw[inside]
            cut = np.cumsum(inside)[start] - 1
        places = np.append(cut, len(raw)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(raw.tobytes())])
        coded = words.dictionary_encode()
        ends = np.cumsum([len(t) + 1 for t in texts])
        n_before = np.append(0, np.cumsum(start)[ends - 1]) if len(texts) else np.zeros(1, np.int64)
        return coded.indices.to_numpy(), coded.dictionary.to_pylist(), n_before

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words as int32 bytes; those of two spans of time are kept, long words are not."""
        if len(self.words) > MEMO:
            self.before, self.words = self.words, {}
        get = self.words.get
        out = [get(w) for w in words]
        new = [k for k, x in enumerate(out) if x is None]
        plain = []
        for k in new:
            w = words[k]
            out[k] = self.before.get(w)
            if out[k] is not None:
                self.words[w] = out[k]
            elif len(w) > 64:
                out[k] = self._long_word(self._symbols(w))
            else:
                plain.append(k)
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            for k, ids in zip(part, self._known_words([self._symbols(words[k]) for k in part])):
                out[k] = self.words[words[k]] = ids
        return out

    @staticmethod
    def _symbols(word: bytes) -> str:
        return word[:-1].decode("latin-1") + chr(256 + word[-1])

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); each distinct word is encoded once.

        Strings of special tokens in a text are those tokens, as in the library.
        """
        parts: list[str] = []
        owner: list[int] = []
        between: list[tuple[int, int, int]] = []  # (text, parts before it, id)
        for k, t in enumerate(texts):
            cut = self.specials.split(t) if t and self.specials else [t or ""]
            for p, x in enumerate(cut):
                if p % 2:
                    between.append((k, len(parts), self.special[x]))
                else:
                    parts.append(self.normal(x))
                    owner.append(k)
        code, distinct, n_before = self._cut(parts)
        known = self._learn(distinct)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<i4")
        at = np.cumsum(sizes) - sizes
        n = sizes[code]
        ends = np.cumsum(n)
        flat = pool[np.repeat(at[code] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        part_end = np.append(0, ends)[n_before]  # ids before each part, and all
        owner_of = np.array(owner, np.int64)
        per_text = np.bincount(owner_of, np.diff(part_end), len(texts)).astype(np.int64) if owner else np.zeros(len(texts), np.int64)
        if between:
            where = np.array([part_end[p] for _, p, _ in between])
            flat = np.insert(flat, where, np.array([i for *_, i in between], flat.dtype))
            per_text += np.bincount([k for k, *_ in between], minlength=len(texts))
        return flat.astype("<i4"), np.append(0, np.cumsum(per_text))

    def decode(self, ids) -> str:
        """The tokens of ids with one space between them: these files name no decoder; unknown ids give nothing."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


_CODECS: dict[int, WordCodec] = {}


def codec(spec) -> WordCodec:
    """One codec for each Python worker and broadcast tokenizer."""
    if spec.id not in _CODECS:
        _CODECS.clear()
        _CODECS[spec.id] = WordCodec(spec.value)
    return _CODECS[spec.id]


def slices(sizes: list[int], rows: int = 500, amount: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Stretches of at most ``rows`` rows and ``amount`` in sum, but of one row at least."""
    at = 0
    while at < len(sizes):
        end, n = at, 0
        while end < len(sizes) and end - at < rows and (end == at or n + sizes[end] <= amount):
            n += sizes[end]
            end += 1
        yield at, end
        at = end


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True, packed: bool = False) -> DataFrame:
    """Per row of ``docs``: id, ids and, with ``decoded``, the text of these ids.

    ``ids`` is an array of int or, with ``packed``, binary: little-endian 32-bit numbers, as
    token files hold them. A null text counts as empty: no ids, empty text. Texts of any
    length are encoded whole; repeated rows give repeated results, an empty table none. Rows
    are independent, so nothing is shuffled; other columns, whatever their names, are not read.
    """
    shared = Shared(docs.sparkSession, load_tokenizer(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices([len(t or "") for t in texts]):
                flat, offsets = c.encode_all(texts[a:b])
                if packed:
                    raw = [pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())]
                    ids = pa.Array.from_buffers(pa.binary(), b - a, [None, *raw])
                else:
                    ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                out = [batch.column(0).slice(a, b - a), ids]
                if decoded:
                    out.append(pa.array([c.decode(flat[x:y].tolist()) for x, y in zip(offsets, offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])

    kind = f"id {dict(docs.dtypes)[id_col]}, ids {'binary' if packed else 'array<int>'}" + ", decoded string" * decoded
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id_col)
