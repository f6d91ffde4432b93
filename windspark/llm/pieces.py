"""SentencePiece BPE encoding and decoding by a prefix table.

For every prefix of a text the encoding has one last token. Walking the text once, an
Aho-Corasick automaton lists the pieces that end at each position; the last token of the
prefix is the one that is compatible with the last token of the prefix before it, where
two tokens are compatible if merging their joined text gives back these two. The ids are
then read backwards from the table. The time is linear in the text, also for one word of
a megabyte.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


MARK = "▁"
#: Entries that a worker's memo tables hold before they start anew.
MEMO = 150_000


def load_vocabulary(model_path: str) -> dict:
    """What encoding needs of a model file: scores and ids of pieces, byte ids, unknown id.

    Read on the driver and sent to the tasks: its size is that of the vocabulary.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {
        "pieces": {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain},
        "bytes": {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)},
        "unknown": sp.unk_id(),
        "n": len(ids),
    }


class Table:
    """Whole-number keys (from 0) to small numbers, looked up for many keys at once; open addressing."""

    def __init__(self, slots: int, kind=np.int32):
        self.mask, self.shift, self.used = slots - 1, np.uint64(65 - slots.bit_length()), 0
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots, kind)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is not held."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not held yet; the table must stay mostly empty."""
        self.used += len(keys)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # the last of those that meet in a slot
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & self.mask


class _Automaton:
    """Aho-Corasick automaton of the pieces in arrays, stepped for many words at once.

    ``longest`` has for each state the state of the longest piece that ends there, and
    ``shorter`` for that one the next shorter; ``piece`` has the id at a piece's state.
    """

    def __init__(self, ids: dict[str, int]):
        self.child: dict[int, int] = {}
        code = {ch: k for k, ch in enumerate(sorted(set("".join(ids))))}
        self.code_of = np.zeros(0x110000, np.uint16 if len(code) < 1 << 16 else np.int32)
        self.code_of[[ord(c) for c in code]] = list(code.values())
        self.width = len(code)
        by_depth: list[list[tuple[int, int, int]]] = []
        piece = {}
        for p, i in ids.items():
            state = 0
            for depth, ch in enumerate(p):
                key = state * self.width + code[ch]
                new = self.child.get(key)
                if new is None:
                    new = self.child[key] = len(self.child) + 1
                    if depth == len(by_depth):
                        by_depth.append([])
                    by_depth[depth].append((new, state, code[ch]))
                state = new
            piece[state] = i
        n = len(self.child) + 1
        fail, self.longest, self.shorter, self.piece = [0] * n, [0] * n, [0] * n, [-1] * n
        for state, i in piece.items():
            self.piece[state] = i
        for states in by_depth:
            for state, parent, ch in states:
                back = fail[parent]
                while back and back * self.width + ch not in self.child:
                    back = fail[back]
                fail[state] = self.child.get(back * self.width + ch, 0) if parent else 0
                under = self.longest[fail[state]]
                self.longest[state], self.shorter[state] = (state, under) if self.piece[state] >= 0 else (under, under)
        self.fail = fail
        self.arrays = [np.array(x, np.int32) for x in (fail, self.longest, self.shorter, self.piece)]
        self.table = Table(1 << (4 * n).bit_length())
        self.table.put(np.fromiter(self.child, np.int64, n - 1), np.fromiter(self.child.values(), np.int32, n - 1))

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """States after one more character each; every character is a piece."""
        out = self.table.get(state.astype(np.int64) * self.width + code)
        todo = np.flatnonzero(out < 0)
        back = state[todo]
        while len(todo):
            back = self.arrays[0][back]
            found = self.table.get(back.astype(np.int64) * self.width + code[todo])
            out[todo] = found
            todo, back = todo[found < 0], back[found < 0]
        return out

    def step_one(self, state: int, code: int) -> int:
        while True:
            found = self.child.get(state * self.width + code)
            if found is not None:
                return found
            state = self.fail[state]


class Codec:
    """Encoder and decoder of one process; no dummy ids, no sampling, one dummy space in front."""

    def __init__(self, vocabulary: dict):
        self.pieces = vocabulary["pieces"]
        self.bytes = vocabulary["bytes"]
        self.unknown = vocabulary["unknown"]
        self.score = {p: s for p, (_, s) in self.pieces.items()}
        self.name = {i: p for p, (i, _) in self.pieces.items()}
        self.start = vocabulary["n"]  # stands in the table for the place before a word
        self.size = np.zeros(self.start + 1, np.int32)
        for p, (i, _) in self.pieces.items():
            self.size[i] = len(p)
        self.words: dict[str, bytes] = {}  # ids of words as int32 bytes, and the same of the time before
        self.before: dict[str, bytes] = {}
        # pieces that merging never gives are left out
        self.automaton = _Automaton({p: i for p, (i, _) in self.pieces.items() if self.merged(p) == [p]})
        self.pairs = Table(1 << 20, np.int8)
        # No piece has a mark after another character, nor one of these controls: merging
        # never crosses those places, so a text is encoded piece of text by piece of text.
        self.inside = frozenset("".join(self.pieces))
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in self.inside)
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            self.words_of = lambda text: [text]
        else:
            one = f"|[{alone}]" if alone else ""
            self.words_of = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+{one}", re.S).findall
        self.out: list[bytes | None] = [None] * vocabulary["n"]  # None: control ids have no text
        for p, (i, _) in self.pieces.items():
            self.out[i] = p.replace(MARK, " ").encode()
        self.out[self.unknown] = " ⁇ ".encode()
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        self.marked = {i for p, (i, _) in self.pieces.items() if p[:1] == MARK}
        self.byte_of = {i: b for b, i in self.bytes.items()}

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best scored adjacent pair first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether merging leaves these two neighbours as they are: no merge may cross their border."""
        parts, border, score = list(left + right), len(left), self.score
        none = float("-inf")
        scores = [score.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            at = scores.index(best)  # the leftmost of equals
            if best == none or at + 1 == border:
                break
            border -= at + 1 < border
            parts[at] += parts.pop(at + 1)
            del scores[at]
            if at:
                scores[at - 1] = score.get(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score.get(parts[at] + parts[at + 1], none)
        return len(parts) == 2 and border == 1 and (not scores or scores[0] == none)

    def _compatible(self, left: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """By pair of ids: whether they may stand side by side; each distinct pair is tested once."""
        keys = left.astype(np.int64) * self.start + piece
        found = self.pairs.get(keys)
        first = left == self.start
        found[first] = 1
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.pairs.used > 3 * MEMO:  # bounds the memory of long runs
                self.pairs = Table(1 << 20, np.int8)
            distinct, at = np.unique(keys[new], return_inverse=True)
            name = self.name
            ok = np.array([self.fits(name[k // self.start], name[k % self.start]) for k in distinct.tolist()], np.int8)
            self.pairs.put(distinct, ok)
            found[new] = ok[at]
        return found > 0

    def _known_words(self, words: list[str]) -> list[bytes]:
        """Ids of words whose every character is a piece, as int32 bytes.

        The table ``last`` has a place for every prefix of every word, for the id of the
        prefix's last token. All words are walked together, one character at a time: of
        the pieces that end there the one is taken that is compatible with the last token
        of what is left of it. Then the ids are read backwards.
        """
        if not words:
            return []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        n_longer = np.cumsum(np.bincount(sizes)[::-1])[::-1]  # words of at least so many characters
        base = (np.cumsum(sizes + 1) - sizes - 1)[order]
        auto = self.automaton
        text = np.frombuffer((" ".join(words) + " ").encode("utf-32-le"), np.uint32)
        codes = auto.code_of[text]
        _, longest, shorter, piece_at = auto.arrays
        last = np.full(len(text), self.start, np.int32)
        state = np.zeros(len(words), np.int32)
        for j in range(int(sizes.max())):
            n = int(n_longer[j + 1])
            state[:n] = auto.step(state[:n], codes[base[:n] + j])
            place = base[:n] + j + 1
            node = longest[state[:n]]
            while len(place):
                piece = piece_at[node]
                ok = self._compatible(last[place - self.size[piece]], piece)
                last[place[ok]] = piece[ok]
                place, node = place[~ok], shorter[node[~ok]]
        return self._read_back(last, base + sizes[order], np.cumsum(sizes + 1) - 1)

    def _read_back(self, last: np.ndarray, at: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids by word: token ends are marked backwards, one token of every word at a time."""
        token_end = np.zeros(len(last), bool)
        while len(at):
            token_end[at] = True
            at = at - self.size[last[at]]
            at = at[last[at] != self.start]
        cut = np.append(0, np.cumsum(token_end)[ends] * 4).tolist()
        flat = last[token_end].astype("<i4").tobytes()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def _long_word(self, word: str) -> bytes:
        """The same for one word of any length, without the cost of many short steps."""
        auto, size, start = self.automaton, self.size.tolist(), self.start
        last, state, known = [start], 0, {}
        for code in auto.code_of[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist():
            state = auto.step_one(state, code)
            node = auto.longest[state]
            while True:
                piece = auto.piece[node]
                left = last[len(last) - size[piece]]
                ok = known.get((left, piece))
                if ok is None:
                    if len(known) > MEMO:
                        known.clear()
                    known[left, piece] = ok = left == start or self.fits(self.name[left], self.name[piece])
                if ok:
                    break
                node = auto.shorter[node]
            last.append(piece)
        end = np.array([len(word)])
        return self._read_back(np.array(last, np.int32), end, end)[0]

    def _word_with_unknown(self, word: str) -> bytes:
        """Characters that are no piece stand alone unless a longer piece holds them."""
        out: list[int] = []
        for run in re.split(self._outside, word):
            if not run:
                continue
            if self.single.issuperset(run):
                out += np.frombuffer(self._long_word(run), "<i4").tolist()
                continue
            for p in self.merged(run) if run[0] in self.inside else [run]:
                if p in self.pieces:
                    out.append(self.pieces[p][0])
                elif self.bytes:
                    out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
                else:
                    out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    @functools.cached_property
    def _outside(self):
        """One character that no piece holds."""
        return re.compile("([^" + "".join(map(re.escape, sorted(self.inside))) + "])", re.S)

    def _learn_words(self, words: set[str]) -> None:
        """Puts the ids of all ``words`` in the table; the words of two spans of time are kept."""
        if len(self.words) > MEMO:
            self.before, self.words = self.words, {}
        new = words.difference(self.words)
        again = new & self.before.keys()
        self.words.update((w, self.before[w]) for w in again)
        new -= again
        single = self.single
        long = {w for w in new if len(w) > 64}
        plain = [w for w in new if single.issuperset(w) and w not in long]
        at = 0
        while at < len(plain):  # by about a million characters
            end, n = at, 0
            while end < len(plain) and (n < 1_000_000 or end == at):
                n += len(plain[end])
                end += 1
            self.words.update(zip(plain[at:end], self._known_words(plain[at:end])))
            at = end
        if len(plain) < len(new):
            self.words.update((w, self._long_word(w) if single.issuperset(w) else self._word_with_unknown(w)) for w in new.difference(plain))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text); each distinct word is encoded once."""
        split = [self.words_of(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen: set[str] = set()
        for words in split:
            seen.update(words)
        self._learn_words(seen)
        get = self.words.__getitem__
        parts = [b"".join(map(get, words)) for words in split]
        for w in seen:
            if len(w) > 64:  # not kept
                del self.words[w]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
        return np.frombuffer(b"".join(parts), "<i4"), offsets

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD one by one."""
        try:
            text = b"".join(map(self.out.__getitem__, ids)).decode()
        except (UnicodeDecodeError, TypeError):
            text = self._decode_bytes(ids)
        first = next((i for i in ids if self.out[i]), None)
        return text[1:] if first in self.marked else text

    def _decode_bytes(self, ids) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.byte_of:
                run += self.out[i]
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[:k].decode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None and self.out[i]:
                out.append(self.out[i].decode())
        return "".join(out)


_CODECS: dict[int, Codec] = {}


def codec(vocabulary) -> Codec:
    """One codec for each Python worker and broadcast vocabulary."""
    if vocabulary.id not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary.id] = Codec(vocabulary.value)
    return _CODECS[vocabulary.id]


class Shared:
    """A broadcast value with a key that workers can memoise by."""

    def __init__(self, spark, value):
        self._b = spark.sparkContext.broadcast(value)
        self.id = self._b._jbroadcast.id()

    def __getstate__(self):
        return {"_b": self._b, "id": self.id}

    @property
    def value(self):
        return self._b.value


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Per row of ``docs``: id, ids (array of int) and, with ``decoded``, the text of these ids.

    A null text counts as empty: no ids, empty text. Texts of any length are encoded
    whole. Rows are independent, so nothing is shuffled; other columns are not read.
    """
    shared = Shared(docs.sparkSession, load_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                flat, offsets = c.encode_all(part.column(1).to_pylist())
                out = [part.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))]
                if decoded:
                    out.append(pa.array([c.decode(flat[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["id", "ids", "decoded"][: len(out)])

    kind = f"id {dict(docs.dtypes)[id_col]}, ids array<int>" + ", decoded string" * decoded
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id_col)
