"""Token counts by a tokenizer compiled to deterministic transducers.

A byte-level BPE tokenizer is compiled into two finite machines:

* the pre-tokenizer: an automaton over classes of characters whose
  transitions say where a pre-token begins.  Its transition monoid is small,
  so the state before every character comes from a parallel prefix scan over
  monoid elements (chunks of text compose to one element each);
* the merges: a transducer over bytes whose transitions carry the change in
  the number of emitted tokens.  Its states are compiled when first reached
  and kept by the worker.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import pieces, word_hashes

# Classes of characters that the pre-tokenizer tells apart.
_LETTER, _STMD, _R, _V, _L, _E, _NUMBER, _BLANK, _SPACE, _QUOTE, _OTHER, _RESET = range(12)
# States: a token begins with the next character; within letters, numbers or others; after one blank or other space; after more of
# them that end so; after a quote that begins a token; after such a quote and r, v or l.
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _BLANK1, _SPACE1, _BLANKS, _SPACES, _AT_QUOTE, _AT_R, _AT_V, _AT_L = range(12)
#: Outputs: a token begins at this character; one begins at the character before.
_HERE, _BEFORE = 1, 2


def _pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for (state, class) of the pattern with contractions, runs that take one blank along, and spaces."""
    letters = (_LETTER, _STMD, _R, _V, _L, _E)
    to = np.zeros((12, 12), np.uint8)
    out = np.zeros((12, 12), np.uint8)
    begin = {**dict.fromkeys(letters, _LETTERS), _NUMBER: _NUMBERS, _BLANK: _BLANK1, _SPACE: _SPACE1, _QUOTE: _AT_QUOTE, _OTHER: _OTHERS}
    for state in range(12):
        for kind, target in begin.items():
            to[state, kind], out[state, kind] = target, _HERE
    joined = {**dict.fromkeys(letters, _LETTERS), _NUMBER: _NUMBERS, _QUOTE: _OTHERS, _OTHER: _OTHERS}
    for kind in letters:
        out[_LETTERS, kind] = 0
    out[_NUMBERS, _NUMBER] = 0
    for kind in (_QUOTE, _OTHER):  # a quote within other characters begins nothing
        to[_OTHERS, kind], out[_OTHERS, kind] = _OTHERS, 0
        to[_AT_QUOTE, kind], out[_AT_QUOTE, kind] = _OTHERS, 0
    for state in (_BLANK1, _BLANKS):  # the last blank belongs to what follows
        for kind, target in joined.items():
            to[state, kind], out[state, kind] = target, _BEFORE if state == _BLANKS else 0
    for kind in (*letters, _NUMBER, _QUOTE, _OTHER):
        out[_SPACES, kind] = _HERE | _BEFORE
    for state in (_BLANK1, _SPACE1, _BLANKS, _SPACES):
        to[state, _BLANK], out[state, _BLANK] = _BLANKS, 0
        to[state, _SPACE], out[state, _SPACE] = _SPACES, 0
    for kind, target in ((_STMD, _FRESH), (_R, _AT_R), (_V, _AT_V), (_L, _AT_L)):
        to[_AT_QUOTE, kind], out[_AT_QUOTE, kind] = target, 0
    for state, last in ((_AT_R, _E), (_AT_V, _E), (_AT_L, _L)):
        for kind in range(12):
            if kind == last:
                to[state, kind], out[state, kind] = _FRESH, 0
            elif kind in letters:
                out[state, kind] = _BEFORE
            elif kind != _RESET:
                out[state, kind] = _HERE | _BEFORE
    to[:, _RESET], out[:, _RESET] = _FRESH, 0
    out[[_AT_R, _AT_V, _AT_L], _RESET] = _BEFORE
    return to, out


def _monoid(to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product of two elements, state that an element leads to from a state)."""
    elements: dict[bytes, int] = {np.arange(len(to), dtype=np.uint8).tobytes(): 0}
    queue = [np.arange(len(to), dtype=np.uint8)]
    generators = [np.ascontiguousarray(to[:, c]) for c in range(to.shape[1])]
    for e in queue:
        for g in generators:
            made = g[e]
            if elements.setdefault(made.tobytes(), len(elements)) == len(queue):
                queue.append(made)
    maps = np.stack(queue)
    product = np.empty((len(maps), len(maps)), np.uint16)
    for a in range(len(maps)):
        product[a] = [elements[x.tobytes()] for x in maps[:, maps[a]]]
    return np.array([elements[g.tobytes()] for g in generators], np.uint16), product, maps


class PreTokenizer:
    """Where pre-tokens begin, by a prefix scan of the automaton's transition monoid."""

    def __init__(self):
        self.to, self.out = _pretokenizer()
        self.generator, self.product, self.maps = _monoid(self.to)
        kinds = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            category = unicodedata.category(chr(c))[0]
            if category == "L":
                kinds[c] = _LETTER
            elif category == "N":
                kinds[c] = _NUMBER
        kinds[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        kinds[0x20] = _BLANK
        kinds[ord("'")] = _QUOTE
        kinds[[ord(c) for c in "stmd"]] = _STMD
        kinds[ord("r")], kinds[ord("v")], kinds[ord("l")], kinds[ord("e")] = _R, _V, _L, _E
        self.kinds = kinds

    def states(self, symbols: np.ndarray) -> np.ndarray:
        """The state before each symbol, starting fresh."""
        n = 1 << max(1, (len(symbols) - 1).bit_length())
        level = np.zeros(n, np.uint16)
        level[: len(symbols)] = self.generator[symbols]
        levels = [level]
        while len(level) > 1:
            level = self.product[level[::2], level[1::2]]
            levels.append(level)
        states = np.array([_FRESH], np.uint8)
        for level in reversed(levels[:-1]):
            below = np.empty(len(level), np.uint8)
            below[::2] = states
            below[1::2] = self.maps[level[::2], states]
            states = below
        return states[: len(symbols)]

    def starts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Byte positions at which a pre-token begins, in the texts data[begin:end]."""
        mark = np.zeros(len(data) + 1, np.int8)
        np.add.at(mark, begin, 1)
        np.add.at(mark, end, -1)
        lead = np.flatnonzero(((data & 0xC0) != 0x80) & (np.cumsum(mark[:-1]) > 0))
        code = data[lead].astype(np.int32)
        kind = self.kinds[code]
        for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
            some = np.flatnonzero((code >= low) & (code < (low | (0x80 >> (size - 1)) | mask)) & (code < 0xF8) & (code >> (7 - size) == (1 << (size + 1)) - 2))
            if len(some):
                at = lead[some]
                c = code[some] & mask
                for k in range(1, size):
                    c = (c << 6) | (data[np.minimum(at + k, len(data) - 1)] & 0x3F)
                kind[some] = self.kinds[np.minimum(c, 0x10FFFF)]
        opened = np.zeros(len(data) + 1, np.int32)
        opened[begin] = 1
        text = np.cumsum(opened)[lead]  # 1 for the first text
        symbols = np.full(len(lead) + len(begin) + 1, _RESET, np.uint8)
        place = np.arange(len(lead)) + text
        symbols[place] = kind
        said = self.out[self.states(symbols), symbols]
        begins = (said & _HERE) > 0
        begins[:-1] |= (said[1:] & _BEFORE) > 0
        return lead[begins[place]]


class Merges:
    """The merges as a transducer over bytes.

    In a sequence of tokens that the merges produce, whether a token may
    follow another depends on these two alone, and every prefix of a word has
    exactly one last token that may follow the last token of what precedes it.
    A state holds, for every place from which the bytes so far are the
    beginning of some token, how far they are in the vocabulary's trie, the
    last token at that place, and the number of tokens up to it relative to
    now.  Reading a byte changes the number of tokens by the transition's
    annotation.
    """

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.merges = merges
        self.bytes_of = {i: b for b, i in vocab.items()}
        self.byte_token = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, i in vocab.items():
            node = 0
            for b in text:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.made_of = {made: pair for pair, (_, made) in sorted(merges.items(), key=lambda m: -m[1][0])}
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.made: dict[int, bool] = {}
        self.reset()

    #: States after which the compiled part is thrown away and begun anew (bounded memory).
    MOST_STATES = 300_000

    def reset(self):
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        #: Column of each byte in the tables; a byte gets one when first read.
        self.column = np.full(256, -1, np.int32)
        self.to = np.full((1024, 32), -1, np.int32)
        self.change = np.zeros((1024, 32), np.int8)
        self.follows: dict[tuple[int, int], bool] = {}

    def encode(self, text: bytes) -> list[int]:
        """The merges applied as they are defined, lowest rank first."""
        ids = [self.byte_token[b] for b in text]
        while len(ids) > 1:
            best = min(((self.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merges[ids[k], ids[k + 1]][1]]
        return ids

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The token and its outermost parts on one side (0 left, 1 right), each with the rank at which it is merged away."""
        key = (token, side)
        known = self.spines.get(key)
        if known is None:
            known, gone = [], float("inf")
            while True:
                known.append((token, gone))
                if token not in self.made_of:
                    break
                pair = self.made_of[token]
                gone, token = self.merges[pair][0], pair[side]
            self.spines[key] = known
        return known

    def reachable(self, token: int) -> bool:
        known = self.made.get(token)
        if known is None:
            known = self.made[token] = self.encode(self.bytes_of[token]) == [token]
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a and b apart.

        They meet if some right part of a and left part of b have a merge that
        comes before either is merged away; at equal rank the leftmost wins.
        """
        key = (a, b)
        known = self.follows.get(key)
        if known is None:
            known = self.reachable(a) and self.reachable(b)
            if known:
                left = self.spine(b, 0)
                for x, gone in self.spine(a, 1):
                    for y, away in left:
                        m = self.merges.get((x, y))
                        if m is not None and m[0] < gone and m[0] <= away:
                            known = False
            self.follows[key] = known
        return known

    def compile(self, state: int, byte: int) -> None:
        open_, last, change = [], None, 0
        for node, token, count in self.states[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            open_.append((child, token, count))
            t = self.token[child]
            if last is None and t >= 0 and (self.reachable(t) if token < 0 else self.may_follow(token, t)):
                last, change = t, count + 1
        if last is None:
            raise ValueError("the vocabulary lacks a byte")
        entry = (*((n, t, c - change) for n, t, c in open_ if self.children[n]), (0, last, 0))
        at = self.number.setdefault(entry, len(self.states))
        if at == len(self.states):
            self.states.append(entry)
            if at == len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.change = np.concatenate([self.change, np.zeros_like(self.change)])
        self.to[state, self.column[byte]], self.change[state, self.column[byte]] = at, change

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end], all words a byte at a time."""
        if len(self.states) > self.MOST_STATES:
            self.reset()
        order = np.argsort(start - end, kind="stable")  # longest first
        begin, size = start[order], (end - start)[order]
        for b in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)):
            self.column[b] = self.column.max() + 1
        if self.column.max() >= self.to.shape[1]:
            wider = -(-(int(self.column.max()) + 1) // 32) * 32 - self.to.shape[1]
            self.to = np.pad(self.to, ((0, 0), (0, wider)), constant_values=-1)
            self.change = np.pad(self.change, ((0, 0), (0, wider)))
        state = np.zeros(len(order), np.int32)
        total = np.zeros(len(order), np.int64)
        step, active = 0, int(np.searchsorted(-size, 0))
        while active:
            byte = data[begin[:active] + step]
            now, column = state[:active], self.column[byte]
            nxt = self.to[now, column]
            missing = np.flatnonzero(nxt < 0)
            if len(missing):
                for key in np.unique(now[missing].astype(np.int64) * 256 + byte[missing]).tolist():
                    self.compile(key >> 8, key & 255)
                nxt = self.to[now, column]
            total[:active] += self.change[now, column]
            state[:active] = nxt
            step += 1
            active = int(np.searchsorted(-size[:active], -step))
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    table |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return table


class Compiled:
    """A compiled tokenizer and the counts of pre-tokens seen by this worker."""

    #: Pre-tokens whose counts are kept.
    MOST_WORDS = 2_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        if said["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or said.get("normalizer"):
            raise ValueError("only byte-level BPE without normaliser or prefix space is compiled")
        of = _byte_characters()
        raw = lambda s: bytes(of[c] for c in s)
        vocab = {raw(k): v for k, v in said["model"]["vocab"].items() if all(c in of for c in k)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        merges = {(vocab[raw(a)], vocab[raw(b)]): (rank, vocab[raw(a) + raw(b)]) for rank, (a, b) in enumerate(pairs)}
        special = said.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError("added tokens that take spaces along are not compiled")
        self.special = sorted((t["content"].encode() for t in special), key=len, reverse=True)
        for s in self.special:
            vocab.pop(s, None)
        self.pre = PreTokenizer()
        self.merges = Merges(vocab, merges)
        self.forget()

    def forget(self):
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, text) of the stretches between special strings, and the special tokens of each text."""
        n = len(offsets) - 1
        extra = np.zeros(n, np.int64)
        begin, end = offsets[:-1], offsets[1:]
        text = np.arange(n)
        raw = data.tobytes() if self.special else b""
        if any(s in raw for s in self.special):
            b, e, t = [], [], []
            for k in range(n):
                at, stop = int(offsets[k]), int(offsets[k + 1])
                while True:
                    hit = min(((p, -len(s)) for s in self.special if (p := raw.find(s, at, stop)) >= 0), default=None)
                    b.append(at), e.append(hit[0] if hit else stop), t.append(k)
                    if hit is None:
                        break
                    extra[k] += 1
                    at = hit[0] - hit[1]
            begin, end, text = np.array(b), np.array(e), np.array(t)
        some = end > begin
        return begin[some], end[some], text[some], extra

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        begin, end, text, total = self._segments(data, offsets)
        if not len(begin):
            return total
        start = self.pre.starts(data, begin, end)
        segment = np.searchsorted(begin, start, "right") - 1
        stop = np.minimum(np.append(start[1:], len(data)), end[segment])
        hashes, first, of = np.unique(word_hashes(data, start, stop), return_index=True, return_inverse=True)
        tokens = np.zeros(len(hashes), np.int64)
        new = np.ones(len(hashes), bool)
        if len(self.hashes):
            at = np.searchsorted(self.hashes, hashes)
            at[at == len(self.hashes)] = 0
            new = self.hashes[at] != hashes
            tokens = np.where(new, 0, self.known[at])
        if new.any():
            tokens[new] = self.merges.counts(data, start[first[new]], stop[first[new]])
            if len(self.hashes) + new.sum() > self.MOST_WORDS:
                self.forget()
            both = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(both, kind="stable")
            self.hashes, self.known = both[order], np.concatenate([self.known, tokens[new]])[order]
        return total + np.bincount(text[segment], weights=tokens[of], minlength=len(total)).astype(np.int64)


_compiled: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """The tokenizer at ``path``, compiled once per worker process."""
    if path not in _compiled:
        _compiled.clear()
        _compiled[path] = Compiled(path)
    return _compiled[path]


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text by the byte-level BPE tokenizer file at ``path`` (on every executor).

    Counts are those of the file's own library without begin, end or padding
    tokens and without truncation; a special token's string inside a text
    counts as that one token.  Each text is handled by one task, in pieces of
    bounded size but for single longer texts; nothing is shuffled.  Equal
    pre-tokens of a worker are counted once.

    Returns per row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (more than ``limit`` tokens).  Null text counts as empty;
    repeated rows are counted one by one; other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            sizes, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in pieces(batch.column(1)):
                sizes.append(np.diff(offsets))
                tokens.append(machine.count(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens))], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
