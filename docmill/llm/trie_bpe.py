"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch form a trie. A depth-first walk keeps, for each prefix on the path, the last token of its encoding; a prefix that many
words share is computed once. The last token of a prefix is the one token t that ends it such that t may stand after the last token of what comes
before t; so the last tokens alone give back the whole encoding, from the end.

Whether t may stand after u: no merge crosses their border before it is too late. On either side of the border stand, one after the other, the tokens
of u's right spine and of t's left spine (those that u and t were merged from, at the border). A crossing merge of a and b, if there is one, happens
when its rank is below that of the merge that takes a up, and not above that of the merge that takes b up (of two equal merges the left goes first).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from docmill.llm._common import ID, keyless_rows, unique_rows
from docmill.llm._tokens import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
WORDS_HELD = 150_000  # words whose ids a worker keeps; beyond that it starts anew
SLICE = 2 << 20  # characters of text whose words form a trie

NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes as they are, the others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class TrieCoder:
    """A byte-level BPE vocabulary in the tokenizers library's file format, with its added tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in vocab.items()}
        self._automaton()
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            parts.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.left, self.right = self._spines(parts, 1), self._spines(parts, 2)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split_words = regex.compile(public_tokenizers.PATTERN).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _automaton(self) -> None:
        """States are the prefixes of tokens. step[state * 256 + byte]: the longer prefix; fall[state]: its longest proper end that is a prefix too;
        ends[state]: the longest token that ends it; shorter[token]: the longest token that properly ends that one (-1: none)."""
        self.step: dict[int, int] = {}
        self.fall, self.ends = [0], [-1]
        self.size = [0] * (max(self.bytes_of) + 1)
        self.shorter = [-1] * len(self.size)
        step, fall, ends = self.step, self.fall, self.ends
        level = [(s, i, 0) for i, s in self.bytes_of.items()]
        depth = 0
        while level:
            new: dict[int, int] = {}
            going = []
            for s, i, state in level:
                key = state << 8 | s[depth]
                if key not in new:
                    new[key] = len(fall)
                    at = fall[state]
                    while state and (to := step.get(at << 8 | s[depth])) is None and at:
                        at = fall[at]
                    fall.append(0 if not state or to is None else to)
                    ends.append(ends[fall[-1]])
                state = new[key]
                if len(s) == depth + 1:
                    self.size[i], self.shorter[i], ends[state] = len(s), ends[fall[state]], i
                else:
                    going.append((s, i, state))
            step.update(new)
            level = going
            depth += 1

    def _spines(self, parts: dict[int, tuple[int, int, int]], side: int) -> dict[int, list[tuple[int, int]]]:
        """For each token: (token, rank of the merge that takes it up) along its left (1) or right (2) edge, itself first."""
        out = {}
        for token in self.bytes_of:
            spine, up, at = [], NEVER, token
            while True:
                spine.append((at, up))
                if at not in parts:
                    break
                up, at = parts[at][0], parts[at][side]
            out[token] = spine
        return out

    def may_follow(self, u: int, t: int) -> bool:
        """Whether u, t is the encoding of their bytes."""
        rank = self.rank
        return not any((r := rank.get((a, b))) is not None and r < a_up and r <= b_up for a, a_up in self.right[u] for b, b_up in self.left[t])

    def encode_words(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """The ids of each word, words ascending: neighbours in this order are neighbours in the trie, and the stacks hold the path between them."""
        step, fall, ends, size, shorter, pairs = self.step, self.fall, self.ends, self.size, self.shorter, self.pairs
        if len(pairs) > 1_000_000:
            pairs.clear()
        path = b""
        last: list[int] = [-1]  # last[i]: the last token of the first i bytes
        states: list[int] = [0]  # states[i]: the longest prefix of a token that ends the first i bytes
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, i = states[shared], shared
            for byte in word[shared:]:
                i += 1
                while (to := step.get(state << 8 | byte)) is None:
                    state = fall[state]
                state = to
                states.append(state)
                token = ends[state]
                while before := i - size[token]:
                    u = last[before]
                    pair = u << 20 | token
                    good = pairs.get(pair)
                    if good is None:
                        good = pairs[pair] = self.may_follow(u, token)
                    if good:
                        break
                    token = shorter[token]
                last.append(token)
            path = word
            ids = []
            while i:
                ids.append(last[i])
                i -= size[last[i]]
            yield tuple(ids[::-1])

    def learn(self, words: set[str]) -> None:
        new = words - self.known.keys()
        if len(self.known) + len(new) > WORDS_HELD:
            self.known, new = {}, words
        keyed = sorted((w.encode("utf-8"), w) for w in new)
        self.known.update(zip((w for _, w in keyed), self.encode_words([b for b, _ in keyed]), strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; strings of added tokens in a text are those tokens."""
        pieces = [[self.split_words(p) if k % 2 == 0 else [p] for k, p in enumerate(self.split_added(t))] if self.split_added else [self.split_words(t)] for t in texts]
        self.learn({w for text in pieces for words in text[::2] for w in words})
        known = self.known
        for text in pieces:
            if len(text) == 1:
                yield list(chain.from_iterable(map(known.__getitem__, text[0])))
            else:
                yield [i for k, words in enumerate(text) for w in words for i in (known[w] if k % 2 == 0 else (self.added[w],))]

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def trie_coder(path: str) -> TrieCoder:
    return TrieCoder(path)


def slices(texts: list[str], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about size characters."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _coded(batches: Iterator[pa.RecordBatch], path: str, digest: bool) -> Iterator[pa.RecordBatch]:
    coder = trie_coder(path)
    number = {i: str(i) for i in coder.bytes_of}.__getitem__
    for batch in batches:
        texts = batch.column(1).fill_null("").to_pylist()
        for a, b in slices(texts):
            rows = []
            for ids in coder.encode_batch(texts[a:b]):
                text = coder.decode(ids)
                rows.append((len(ids), hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) if digest else (ids, text))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, zip(*rows, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"])


def encode_and_decode(documents: DataFrame, vocabulary: str, digest: bool = False) -> DataFrame:
    """doc_id, ids and decoded of every text, or with digest: n_tokens, ids_sha256, decoded_sha256.

    A null text is empty: no ids, decoded empty. Rows that repeat a doc_id are one document (its greatest text); rows with a null doc_id are encoded
    like any other. Other columns are ignored. No shuffle: a row's result depends on that row alone.
    """
    docs = unique_rows(documents, ID, "text").unionByName(keyless_rows(documents, ID, "text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<long>, decoded string"
    return docs.mapInArrow(partial(_coded, path=vocabulary, digest=digest), schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9_trie_bpe: the digest of encode_and_decode over documents."""
    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(VOCABULARY), digest=True)
