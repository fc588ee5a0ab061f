"""Byte-level BPE: texts to token ids and back, as the tokenizers library does both.

A text is cut into words by the vocabulary's own rule. The words that a span of
rows brings anew are merged together: a matrix has one row per word with its
parts, and a second one the ranks of adjacent parts. Each round finds the
smallest rank of every row, the leftmost of equals, deletes the boundary there
and looks up the two ranks beside it; rows without a rank left are done. Words
of more than ``SHORT`` bytes, for which rescanning would be quadratic, keep
their candidates in a heap instead.

Known words are kept per worker, at most ``KEPT``. Each text is read once and
never moved; decoding works on the ids alone.

Defined cases: a null or empty text has no tokens; special tokens in a text are
single ids, as in the library; code points that the library's Unicode tables do
not know are symbols, whatever later tables say; ids that do not form UTF-8 are
decoded with replacement characters. Very long texts are cut between words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import spans_of, utf8

TOKENIZER = "byte_bpe_50k.json"
#: Longest word of the matrices in bytes, known words per worker, characters that are cut into words at once.
SHORT, KEPT, PIECE = 64, 400_000, 1_000_000
#: The rank of parts that never merge.
NONE = np.int32(2**31 - 1)
# Fixed value: the word rule of the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same rule where all characters are ASCII.
ASCII_WORDS = r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\x09-\x0D A-Za-z0-9]+|[\x09-\x0D ]+(?![^\x09-\x0D ])|[\x09-\x0D ]+"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown.update({chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return shown


def pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes end to end, and the n + 1 offsets."""
    return np.frombuffer(b"".join(values), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))])


def gathered(values: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``which`` of a pool end to end, and their offsets."""
    length = np.diff(offsets)[which]
    upto = np.concatenate([[0], np.cumsum(length)])
    return values[np.repeat(offsets[which] - upto[:-1], length) + np.arange(upto[-1])], upto


def _ranges(codes: list[int]) -> str:
    """The inside of a character class of ascending code points."""
    firsts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    lasts = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


class Bpe:
    """Encoding and decoding by one vocabulary file."""

    def __init__(self, path: str, short: int = SHORT, kept: int = KEPT):
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, self.short, self.kept = data["model"]["vocab"], short, kept
        shown = byte_names()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        content = [b""] * size
        for token, i in vocab.items():
            content[i] = bytes(map(shown.__getitem__, token))
        for token, i in special.items():
            content[i] = token.encode()
        self.bytes, self.numbers = pool(content), pool([b"%d," % i for i in range(size)])
        self.of_byte = np.zeros(256, np.int32)
        for char, b in shown.items():
            self.of_byte[b] = vocab[char]
        # Pairs of parts in order of a single key, with the rank of each and the part it becomes.
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.becomes = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rule, self.ascii_rule, self.odd = regex.compile(WORDS), re.compile(ASCII_WORDS), self._odd(path)
        self.special = special
        self.split = re.compile("|".join(re.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self._clear()

    def _odd(self, path: str) -> re.Pattern | None:
        """Letters and numbers of this Python that the library does not take for such: all are shown to it once."""
        import regex
        from tokenizers import Tokenizer

        cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
        odd = []
        for kind, mate in ((r"\p{L}", "a"), (r"\p{N}", "1")):
            chars = regex.findall(kind, every)
            # Written behind a mate of its kind and between line feeds, a character stays in one word with it.
            whole = {start for _, (start, end) in cut("\n".join(mate + c for c in chars)) if end - start == 2}
            odd += [ord(c) for k, c in enumerate(chars) if 3 * k not in whole]
        return re.compile("[" + _ranges(sorted(odd)) + "]") if odd else None

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.word_ids, self.word_at, self.used = np.empty(1 << 16, np.int32), [0], 0
        for token, i in self.special.items():
            self._keep([token], [np.array([i], np.int32)])

    def _keep(self, words: list[str], ids: list[np.ndarray]) -> None:
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        while self.used + len(flat) > len(self.word_ids):
            self.word_ids = np.resize(self.word_ids, 2 * len(self.word_ids))
        self.word_ids[self.used : self.used + len(flat)] = flat
        for word, x in zip(words, ids, strict=True):
            self.known[word] = len(self.word_at) - 1
            self.used += len(x)
            self.word_at.append(self.used)

    # ---- words ----------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if self.split is None or not self.split.search(text):
            return self._plain_words(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self._plain_words(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain_words(text[at:])

    def _plain_words(self, text: str) -> list[str]:
        if len(text) > PIECE:
            # A blank behind a printable ASCII character always begins a word.
            out, at = [], 0
            while at < len(text):
                end = at + PIECE
                while 0 <= (end := text.find(" ", end)) and not "!" <= text[end - 1] <= "~":
                    end += 1
                end = len(text) if end < 0 else end
                out += self._words(text[at:end])
                at = end
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_rule.findall(text)
        if self.odd is not None and self.odd.search(text):
            # A symbol stands in for what the library does not take for a letter or number.
            return [text[m.start() : m.end()] for m in self.rule.finditer(self.odd.sub("☃", text))]
        return self.rule.findall(text)

    # ---- merging --------------------------------------------------------------------

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of about one length, all merged at once."""
        raw, offsets = pool(words)
        size = np.diff(offsets)
        width = int(size.max()) + 1
        columns = np.arange(width)
        # Parts of each word, closed by -1, and the ranks of a part and its right neighbour.
        parts = np.full((len(words), width), -1, np.int32)
        parts[columns < size[:, None]] = self.of_byte[raw]
        ranks = np.full((len(words), width), NONE, np.int32)
        inner = columns[:-1] < size[:, None] - 1
        ranks[:, :-1][inner] = self._rank(parts[:, :-1][inner], parts[:, 1:][inner])
        done: list = [None] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            ended = best == NONE
            if ended.any():
                left = (parts[ended] >= 0).sum(1)
                for row, ids, n in zip(rows[ended].tolist(), parts[ended], left.tolist(), strict=True):
                    done[row] = ids[:n].copy()
                stay = ~ended
                rows, parts, ranks, at, best = rows[stay], parts[stay], ranks[stay], at[stay], best[stay]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            # Delete the boundary behind part `at`: all later parts move one place to the left.
            parts[every, at] = self.becomes[best]
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts, ranks = np.take_along_axis(parts, source, 1), np.take_along_axis(ranks, source, 1)
            behind = parts[every, at + 1]
            ranks[every, at] = np.where(behind >= 0, self._rank(parts[every, at], behind), NONE)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._rank(parts[before, at[before] - 1], parts[before, at[before]])
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the smallest rank, leftmost first, from a heap; stale entries are passed over."""
        parts = self.of_byte[np.frombuffer(word, np.uint8)]
        first = self._rank(parts[:-1], parts[1:])
        parts = parts.tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(int(first[i]), i, parts[i], parts[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        ranks = _pair_table(self)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.becomes[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (found := ranks.get((parts[x] << 32) | parts[y])) is not None:
                    heapq.heappush(heap, (found, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], np.int32)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word."""
        data = [w.encode() for w in words]
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(data):
            if len(w) > self.short:
                out[k] = self.merge_long(w)
            else:
                by_size.setdefault(-(-len(w) // 4), []).append(k)
        for group in by_size.values():
            for a in range(0, len(group), 20_000):
                some = group[a : a + 20_000]
                for k, ids in zip(some, self.merge_short([data[k] for k in some]), strict=True):
                    out[k] = ids
        return out

    # ---- texts ----------------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets."""
        found = list(map(self.words, texts))
        words = list(chain.from_iterable(found))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        del found
        if len(self.known) > self.kept:
            self._clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        self._keep(new, self.merge(new))
        which = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids, upto = gathered(self.word_ids, np.asarray(self.word_at), which)
        if any(len(w) > self.short for w in new):
            # Long words seldom come again and would fill the worker.
            self._forget(new)
        return ids, upto[np.concatenate([[0], np.cumsum(counts)])]

    def _forget(self, words: list[str]) -> None:
        for w in words:
            if len(w) > self.short:
                del self.known[w]
        if self.used > 8 * self.kept:
            self._clear()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        raw, upto = gathered(*self.bytes, ids)
        ends = upto[offsets].tolist()
        return [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decimals(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Each run of ids as decimal numbers joined by commas."""
        raw, upto = gathered(*self.numbers, ids)
        ends = upto[offsets].tolist()
        return [raw[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@cache
def _pair_table(bpe: Bpe) -> dict[int, int]:
    return dict(zip(bpe.pairs.tolist(), bpe.ranks.tolist(), strict=True))


@cache
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _spans(batch: pa.RecordBatch):
    """Runs of rows with their texts, about 1.5 MB each."""
    raw, offsets = utf8(batch.column("body"))
    for a, b in spans_of(offsets, 1_500_000):
        ends = offsets[a : b + 1].tolist()
        yield a, b, [raw[x:y].tobytes().decode() for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _bodies(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, ids`` per document."""
    path = tokenizer or tokenizer_path()

    def scan(batches):
        for batch in batches:
            for a, b, texts in _spans(batch):
                ids, ends = _bpe(path).encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    return _bodies(docs).mapInArrow(scan, "doc_id long, ids array<int>")


def decode(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, text`` of rows ``doc_id, ids``; null ids are an empty text."""
    path = tokenizer or tokenizer_path()

    def scan(batches):
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            texts = _bpe(path).decode(ids, np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(scan, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, and its ids decoded again."""
    path = tokenizer or tokenizer_path()

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def scan(batches):
        for batch in batches:
            for a, b, texts in _spans(batch):
                bpe = _bpe(path)
                ids, ends = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), pa.array(np.diff(ends), pa.int64()),
                    pa.array([sha(x) for x in bpe.decimals(ids, ends)]), pa.array([sha(x.encode()) for x in bpe.decode(ids, ends)]),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _bodies(docs).mapInArrow(scan, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
