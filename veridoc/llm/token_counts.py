"""Token counts by finite-state transducers.

Two deterministic machines are compiled from the tokenizer's file.

The pre-tokenizer is a transducer over character classes (thirteen states).  Its transitions are annotated with the
borders they settle, before the current and the previous character.  A batch of texts is one string of classes, cut
into chunks; each chunk gives a state map (entry state to exit state), all chunks and all entry states at once; the maps
compose by a parallel prefix scan (log2 n rounds of gathers), which yields every chunk's true entry state; a second sweep
then reads off the borders.  A text's length therefore never makes a serial run; a single very long pre-token still does, in the
merge machine below.

The merge machine turns a pre-token's bytes into its token count.  Its state is the longest suffix that could still grow
into a token, with the last token and the count at each of that suffix's cuts; a transition is annotated with the tokens
it adds (perhaps fewer than none, when a merge joins what stood apart).  States are determinized on demand and kept, up to a
bound, as are the counts of whole pre-tokens.  The last token at a place is the one token ending there that stays apart
from the token before it, which is decided by merging the two alone.

Special tokens of the file are matched in texts first, as the library does by default, and count one each.

Defined cases: null text counts as empty (0 bytes, 0 tokens); texts of any length are counted whole; repeated rows each
return a row; an empty table returns no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .byte_bpe import heap_merge

#: The characters of Unicode's White_Space property, as ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: Character classes; the letters of contractions stand alone.
SPACE, BLANK, STMD, R, V, L_, E, LETTER, NUMBER, QUOTE, OTHER, RESET = range(12)
_LETTERS = (STMD, R, V, L_, E, LETTER)
#: States: what the unfinished pre-token is.
START, WORD, DIGITS, SIGNS, ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK, APOSTROPHE, AP_R, AP_V, AP_L, CONTRACTED = range(13)
STATES, CLASSES = 13, 12


def char_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, of in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(kind, everything):
            shift = lambda i: i if i < 0xD800 else i + 0x800
            for a, b in ((m.start(), min(m.end(), 0xD800)), (max(m.start(), 0xD800), m.end())):
                if a < b:
                    out[shift(a) : shift(b - 1) + 1] = of
    for a, b in WHITE_SPACE:
        out[a : b + 1] = BLANK
    for chars, of in ((" ", SPACE), ("stmd", STMD), ("r", R), ("v", V), ("l", L_), ("e", E), ("'", QUOTE)):
        for c in chars:
            out[ord(c)] = of
    return out


def border_machine() -> tuple[np.ndarray, np.ndarray]:
    """next state and borders (1: before this character, 2: before the previous one) by state * CLASSES + class."""
    to, marks = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)

    def fresh(c: int) -> int:
        """The state after c as a pre-token's first character."""
        return {SPACE: ONE_SPACE, BLANK: ONE_BLANK, NUMBER: DIGITS, QUOTE: APOSTROPHE, OTHER: SIGNS, RESET: START}.get(c, WORD)

    for s in range(STATES):
        for c in range(CLASSES):
            to[s, c], marks[s, c] = fresh(c), 1
            letter = c in _LETTERS
            if c == RESET:
                marks[s, c] |= 2 * (s in (AP_R, AP_V, AP_L))
            elif s == WORD and letter or s == DIGITS and c == NUMBER:
                to[s, c], marks[s, c] = s, 0
            elif s == SIGNS and c in (QUOTE, OTHER):
                to[s, c], marks[s, c] = SIGNS, 0
            elif s in (ONE_SPACE, ONE_BLANK, MANY_SPACE, MANY_BLANK):
                many = s in (MANY_SPACE, MANY_BLANK)
                if c in (SPACE, BLANK):
                    to[s, c], marks[s, c] = (MANY_SPACE if c == SPACE else MANY_BLANK), 0
                else:  # the last blank leaves the run; a space joins what follows
                    joins = s in (ONE_SPACE, MANY_SPACE)
                    marks[s, c] = 2 * many + (not joins)
                    if joins:
                        to[s, c] = SIGNS if c == QUOTE else fresh(c)
            elif s == APOSTROPHE:
                if c in (QUOTE, OTHER):
                    to[s, c], marks[s, c] = SIGNS, 0
                elif c == STMD:
                    to[s, c], marks[s, c] = CONTRACTED, 0
                elif c in (R, V, L_):
                    to[s, c], marks[s, c] = {R: AP_R, V: AP_V, L_: AP_L}[c], 0
            elif s in (AP_R, AP_V, AP_L):
                if c == (L_ if s == AP_L else E):
                    to[s, c], marks[s, c] = CONTRACTED, 0
                else:  # no contraction: the letter began a word
                    marks[s, c] = 2 + (not letter)
                    if letter:
                        to[s, c] = WORD
    return to.ravel(), marks.ravel()


class Borders:
    def __init__(self, chunk: int = 512):
        self.classes, (self.to, self.marks), self.chunk = char_classes(), border_machine(), chunk

    def __call__(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The texts joined (each followed by a mark), the starts of all pre-tokens in it and the marks' places."""
        joined = "\0".join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.classes[codes]
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds[ends] = RESET
        n, size = len(kinds), self.chunk
        rows = -(-n // size)
        padded = np.full(rows * size, RESET, np.uint8)
        padded[:n] = kinds
        by_place = np.ascontiguousarray(padded.reshape(rows, size).T).astype(np.intp)
        # State maps of all chunks from every entry state.
        maps = np.tile(np.arange(STATES, dtype=np.intp), (rows, 1))
        for kind in by_place:
            maps = self.to[maps * CLASSES + kind[:, None]].astype(np.intp)
        # Inclusive prefix scan: after round k a row composes 2^k chunks.
        step = 1
        while step < rows:
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step], 1)
            step *= 2
        state = np.r_[START, maps[:-1, START]].astype(np.intp)
        found = np.empty((size, rows), np.uint8)
        for place, kind in enumerate(by_place):
            at = state * CLASSES + kind
            found[place] = self.marks[at]
            state = self.to[at].astype(np.intp)
        flat = found.T.ravel()[:n]
        starts = (flat & 1).astype(bool)
        starts[:-1] |= (flat[1:] & 2).astype(bool)
        return joined, np.flatnonzero(starts), ends


class MergeMachine:
    """Counts of byte strings by lazily determinized transitions."""

    def __init__(self, ranks: dict[bytes, int], bound: int = 300_000):
        self.ranks, self.bound = ranks, bound
        self.heads = {t[:i] for t in ranks for i in range(1, len(t) + 1)}
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.moves: dict[int, tuple[int, int]] = {}
        self.number((b"", ((b"", 0),)))

    def number(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def stays_apart(self, a: bytes, b: bytes) -> bool:
        """Whether merging a + b alone gives just these two."""
        if (a, b) not in self.apart:
            if len(self.apart) > 4 * self.bound:
                self.apart.clear()
            self.apart[a, b] = heap_merge(a + b, self.ranks.get) == [self.ranks[a], self.ranks[b]]
        return self.apart[a, b]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, cuts = self.keys[state]
        grown = suffix + bytes((byte,))
        for j, (last, count) in enumerate(cuts):
            token = grown[j:]
            # A token of the file that its own merges don't give is never the last.
            if token in self.ranks and (self.stays_apart(last, token) if last else heap_merge(token, self.ranks.get) == [self.ranks[token]]):
                break
        else:
            raise ValueError(f"byte {byte} isn't in the vocabulary")
        added = count + 1
        j = 0
        while j < len(grown) and grown[j:] not in self.heads:
            j += 1
        cuts = (*((t, c - added) for t, c in cuts[j:]), (token, 0))
        return self.number((grown[j:], cuts)), added

    def __call__(self, piece: bytes) -> int:
        state = total = 0
        for byte in piece:
            move = self.moves.get(at := state << 8 | byte)
            if move is None:
                move = self.moves[at] = self.compile(state, byte)
            state, added = move
            total += added
        if len(self.moves) > self.bound:
            self.clear()
        return total


def byte_chars() -> dict[str, int]:
    """The printable stand-ins that vocabulary files write for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> tuple[dict[bytes, int], list[str]]:
    """Ranks (single bytes, then merges in order) and special strings of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    kind = data.get("pre_tokenizer") or {}
    if data["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or data.get("normalizer") or data["model"].get("ignore_merges"):
        raise ValueError("only plain byte-level BPE files are compiled")
    byte = byte_chars()
    ranks = {bytes((b,)): b for b in range(256)}
    for i, merge in enumerate(data["model"]["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        ranks.setdefault(bytes(byte[c] for c in a + b), 256 + i)
    return ranks, sorted((t["content"] for t in data["added_tokens"]), key=len, reverse=True)


class Counter:
    def __init__(self, ranks: dict[bytes, int], special: list[str], memo: int = 400_000):
        self.borders, self.machine, self.memo = Borders(), MergeMachine(ranks), memo
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> np.ndarray:
        parts = [self.special.split(t) if self.special else [t] for t in texts]
        joined, starts, ends = self.borders([p for ps in parts for p in ps])
        places = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(places, [*places[1:], len(joined)], strict=True)]
        known = self.known
        for p in set(pieces):
            if p not in known:
                known[p] = self.machine(p.encode())
        counts = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        counts[np.searchsorted(starts, ends)] = 0  # the marks
        if len(known) > self.memo:
            known.clear()
        running = np.r_[0, np.cumsum(counts)]
        last = running[np.searchsorted(starts, ends)]
        pieces_each = np.cumsum([len(p) for p in parts])
        at_end = last[pieces_each - 1]
        return np.diff(np.r_[0, at_end]) + np.array([len(p) - 1 for p in parts])


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 512, portion: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).  portion: characters counted at once."""
    ranks, special = read_tokenizer(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), special)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, special))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*shared.value)
        counter = _COUNTERS[key]
        for batch in batches:
            sizes, counts, held, texts = [], [], 0, []
            for row, value in enumerate(batch.column(1)):
                t = value.as_py() or ""
                texts.append(t)
                sizes.append(len(t.encode()))
                held += len(t)
                if held > portion or row == batch.num_rows - 1:
                    counts.append(counter.count(texts))
                    held, texts = 0, []
            if counts:
                n = np.concatenate(counts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, n_tokens bigint, over_limit boolean")
