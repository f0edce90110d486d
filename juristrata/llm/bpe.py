"""BPE encoding and decoding by a prefix-sharing trie.

A text is cut at ASCII white space into pieces. The distinct pieces that a worker has not met yet are normalised and
split into words by the tokenizer file's own rules. The distinct words are laid out as a trie (sorted order; a stack
holds the path of the current word), and a depth-first walk propagates one state a node: the last token of the
encoding of that prefix. A token t ends the prefix p exactly if t may follow the last token of p without t, that is if
the merges leave the two tokens apart; so each shared prefix is encoded once, and a word's tokens are read off by
walking the states back.

Defined cases: a null text counts as empty; an empty text has no tokens; the strings of special tokens are found in
the raw text, as the library does; white space inside other Unicode ranges is handled by the file's normaliser.
Memory: what a worker keeps between batches has a bound (CACHE), and nothing stays between tasks.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristrata.llm.common import release, small_batches

CACHE = 150_000
"""Pieces that a worker keeps at most between batches of a task; words (4/3 of it), pairs of tokens (as many) and states
of short prefixes (2/3) follow. Fewer cost time, not results."""
SHORT = 6
NEVER = 1 << 60
LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u00ff]+")
LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^a-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff]+")
"""Printable Latin-1 without spaces (NFC leaves it as it is), and the usual word pattern on it in lower case."""


class TrieEncoder:
    """Encodes distinct words of one tokenizer file (BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Only the file's normaliser and splitter are needed from the library, so its model stays empty.
        library = Tokenizer.from_str(json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.code = {s: i.to_bytes(4, "little") for s, i in self.vocab.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.apart: dict[tuple[str, str], bool] = {}
        self.spines: dict[str, tuple[list, list] | None] = {}
        self.odd: set[str] = set()
        self.short: dict[str, str | None] = {}
        self.words: dict[str, tuple[bytes, str]] = {t: (i.to_bytes(4, "little"), t) for t, i in self.special.items()}
        self.longest = max(len(self._plain(t)) for t in self.vocab)
        self.pieces: dict[bytes, tuple[bytes, str]] = {}
        self.limit = CACHE
        # The shortcut for printable Latin-1 is taken only for files whose own rules give the same on a probe of all of it.
        letters = {chr(c): self._by_file(chr(c)) for c in range(0xA1, 0x100)}
        self.bytes_of = str.maketrans({c: "".join(w) for c, w in letters.items() if c == c.lower()})
        probe = ["it's", "x!?", "it'll'", "3x45", *(f"a{chr(c)}{chr(c)}'s\u00b2" for c in [*range(33, 127), *range(0xA1, 0x100)] if c != 0xAD)]
        self.plain = all([w.translate(self.bytes_of) for w in LATIN_WORDS.findall(t.lower())] == self._by_file(t) for t in probe)

    def _by_file(self, bit: str) -> list[str]:
        """Words of a piece of text by the tokenizer file's own normaliser and splitter."""
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(bit))]

    def _plain(self, token: str) -> str:
        return token.removesuffix(self.suffix) if self.suffix and token != self.suffix else token

    def _symbols(self, token: str) -> list[str]:
        body = self._plain(token)
        return [*body[:-1], body[-1] + self.suffix] if body != token else list(body)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the merge of lowest rank first, leftmost among equals. Used on single tokens and pairs only."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def _spines(self, token: str) -> tuple[list, list] | None:
        """How the token's right and left ends grow while it is merged, as (symbol, rank of the merge that ends it);
        None if merging its symbols does not give the token. Ranks never fall along the way, as a merge needs parts
        that earlier merges made; where a file breaks that rule, `odd` holds the token."""
        if token in self.spines:
            return self.spines[token]
        symbols, last = self._symbols(token), -1
        right, left = [[symbols[-1], NEVER]], [[symbols[0], NEVER]]
        while len(symbols) > 1:
            rank, at = min((self.rank.get((x, y), NEVER), i) for i, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER:
                break
            if rank < last:
                self.odd.add(token)
            last = rank
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            if at == len(symbols) - 1:
                right[-1][1] = rank
                right.append([symbols[at], NEVER])
            if at == 0:
                left[-1][1] = rank
                left.append([symbols[0], NEVER])
        self.spines[token] = found = (right, left) if symbols == [token] else None
        return found

    def _may_follow(self, left: str, right: str) -> bool:
        """Whether merging both tokens' symbols together leaves exactly these two tokens: no pair of ends that exist at
        the same time may have a merge that comes before either end grows on (at equal ranks the left one goes first)."""
        if (known := self.apart.get((left, right))) is not None:
            return known
        if self.odd and (left in self.odd or right in self.odd):
            known = self.merge(self._symbols(left) + self._symbols(right)) == [left, right]
        else:
            xs, ys, i, j, known, rank = self._spines(left)[0], self._spines(right)[1], 0, 0, True, self.rank
            while True:
                (x, x_ends), (y, y_ends) = xs[i], ys[j]
                across = rank.get((x, y), NEVER)
                if across < x_ends and across <= y_ends and across != NEVER:
                    known = False
                    break
                if x_ends == NEVER and y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
        if len(self.apart) > self.limit:
            self.apart.clear()
        self.apart[left, right] = known
        return known

    def _last(self, word: str, end: int, closed: bool, states: list) -> str | None:
        """The last token of the encoding of word[:end], given the states of all shorter prefixes. Just one token fits,
        so the order of trial is free: the grown last token first, then from the shortest on."""
        tail = self.suffix if closed else ""
        vocab, before = self.vocab, states[end - 1]
        grown = end - 1 - len(before) if before else -1
        if grown >= 0:
            token = word[grown:end] + tail
            if token in vocab and self._spines(token) and (grown == 0 or (states[grown] and self._may_follow(states[grown], token))):
                return token
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            token = word[start:end] + tail
            if start != grown and token in vocab and self._spines(token) and (start == 0 or (states[start] and self._may_follow(states[start], token))):
                return token
        return None

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of distinct words, by one depth-first walk of their trie."""
        out: dict[str, list[str]] = {}
        before, states, short = "", [""], self.short
        if len(short) > 2 * self.limit // 3:
            short.clear()
        for word in sorted(words):
            shared = 0
            top = min(len(before), len(word), len(states) - 1)
            while shared < top and before[shared] == word[shared]:
                shared += 1
            shared = min(shared, len(word) - 1)
            del states[shared + 1 :]
            for end in range(shared + 1, len(word)):
                if end > SHORT:
                    states.append(self._last(word, end, False, states))
                    continue
                prefix = word[:end]
                state = short.get(prefix, 0)
                if state == 0:
                    state = short[prefix] = self._last(word, end, False, states)
                states.append(state)
            token, end, tokens = self._last(word, len(word), True, states), len(word) + len(self.suffix), []
            while token and end:
                tokens.append(token)
                end -= len(token)
                token = states[end]
            out[word] = tokens[::-1] if end == 0 else self._fallback(word)
            before = word
        return out

    def _fallback(self, word: str) -> list[str]:
        """A word with a symbol outside the vocabulary has no chain of states; symbols without an id are left out."""
        return [t for t in self.merge([*word[:-1], word[-1] + self.suffix]) if t in self.vocab]

    def _split(self, bit: str) -> list[str]:
        if self.plain and LATIN.fullmatch(bit):
            found = LATIN_WORDS.findall(bit.lower())
            return found if bit.isascii() else [w.translate(self.bytes_of) for w in found]
        return self._by_file(bit)

    def learn(self, pieces: set[bytes]) -> None:
        """Encode pieces that are not known yet."""
        single: list[tuple[bytes, str]] = []
        several: list[tuple[bytes, list[str]]] = []
        special, cut, split, plain, fits, find = self.special, self.cut, self._split, self.plain, LATIN.fullmatch, LATIN_WORDS.findall
        for piece in pieces:
            text = piece.decode("utf-8")
            if plain and text.isascii() and "<" not in text and fits(text):
                parts = find(text.lower())
            elif cut and "<" in text:
                parts = [x for bit in cut.split(text) if bit for x in ([bit] if bit in special else split(bit))]
            else:
                parts = split(text)
            if len(parts) == 1:
                single.append((piece, parts[0]))
            else:
                several.append((piece, parts))
        words, code = self.words, self.code
        wanted = {w for _, w in single}.union(*(parts for _, parts in several))
        fresh = wanted.difference(words)
        if len(words) + len(fresh) > 4 * self.limit // 3 and words:
            words.clear()
            words.update((t, (i.to_bytes(4, "little"), t)) for t, i in special.items())
            fresh = wanted.difference(words)
        for word, tokens in self.encode_words(fresh).items():
            words[word] = (b"".join([code[t] for t in tokens]), " ".join(tokens))
        known = self.pieces
        for piece, word in single:
            known[piece] = words[word]
        for piece, parts in several:
            found = [words[w] for w in parts]
            known[piece] = (b"".join([i for i, _ in found]), " ".join([s for i, s in found if i]))

    def forget(self) -> None:
        """Drop all that was learnt from texts. A worker outlives its tasks, and a later stage needs the memory more than
        the next task needs the words, most of which are new to it."""
        for kept in (self.pieces, self.words, self.apart, self.spines, self.short):
            kept.clear()
        self.words.update((t, (i.to_bytes(4, "little"), t)) for t, i in self.special.items())
        release()

    def encode_batch(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit, decoded text) for each text."""
        split = [(t or "").encode("utf-8").split() for t in texts]
        fresh = set().union(*split).difference(self.pieces) if split else set()
        if len(self.pieces) + len(fresh) > self.limit and self.pieces:
            self.pieces.clear()
            fresh = set().union(*split)
        self.learn(fresh)
        for pieces in split:
            found = [self.pieces[p] for p in pieces]
            yield b"".join([i for i, _ in found]), " ".join([s for i, s in found if i])
        if len(self.pieces) > self.limit:
            self.pieces.clear()


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder of a tokenizer file, loaded once."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


SCHEMA = "n_tokens long, ids binary, decoded string"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cache: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """For each row: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded (the ids decoded again), and the columns in keep."""
    small_batches(docs.sparkSession)
    keep = keep or []
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} {narrow.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        enc = encoder(path)
        enc.limit = cache or CACHE
        gc.disable()  # nothing here makes cycles, and looking for them among so many words costs an eighth of the time
        try:
            for part in batches:
                got = list(enc.encode_batch(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.binary()), pa.array([s for _, s in got], pa.string()), *part.columns[2:]],
                    names=["doc_id", "n_tokens", "ids", "decoded", *keep],
                )
        finally:
            gc.enable()
            enc.forget()

    return narrow.mapInArrow(run, f"doc_id {kind}, {SCHEMA}{more}")


def decode(ids: bytes, path: str) -> str:
    """The text of little-endian ids, special tokens included."""
    enc = encoder(path)
    return " ".join(enc.token[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))
