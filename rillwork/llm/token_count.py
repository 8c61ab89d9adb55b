"""Token counts by rank-synchronous merging of ragged arrays.

For a byte-level BPE vocabulary with word ends.  A text is normalised and split
into pre-tokens; pre-tokens that a task has not seen are laid out one after the
other in an array of symbols.  In each round every sequence finds its pair of
lowest rank and merges all places of that pair at once; a sequence without
ranked pairs is done, and its surviving symbols are its tokens.  Merging all
places at once equals merging them one by one, as a pair that arises from a
merge always has a higher rank.

Characters that the tokenizer's library normalises or classes otherwise than
Python (it follows another Unicode version) are found once, on the driver; a
text that holds one is split by the library's own pattern.

Special strings inside texts are one token each, as the tokenizer's library
has it by default.  Defined cases: a null text is empty and has no tokens;
repeated rows count alike; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

VOCABULARY = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: Pre-tokens whose counts a task remembers at most; beyond that it forgets all and goes on.
REMEMBERED = 400_000

_NONE = np.int64(1) << 40
UNTRIED = 0x32000
_LETTERS_1 = "a-zªµºß-öø-ÿ"
_NUMBERS_1 = "0-9²³¹¼-¾"
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACES = "\t-\r \x85\xa0  -     　"
#: For lower-case texts of the first 256 code points, and for all.
_SPLIT_1 = re.compile(f"{_CONTRACTED}|[{_LETTERS_1}]+|[{_NUMBERS_1}]|[^{_SPACES}{_LETTERS_1}{_NUMBERS_1}]+")


def _split_all():
    import regex

    return regex.compile(rf"{_CONTRACTED}|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def load_merges(path: str) -> dict:
    """Arrays of a vocabulary file: symbols of bytes inside and at the end of a word, ranked pairs, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    size = max(vocab.values()) + 1
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return {
        "size": size,
        "inside": np.array([vocab[c] for c in byte_symbols()], np.int64),
        "ending": np.array([vocab[c + end] for c in byte_symbols()], np.int64),
        "keys": keys[order],
        "ranks": order.astype(np.int64),
        "made": np.array([vocab[a + b] for a, b in pairs], np.int64),
        "pattern": pattern,
        "odd": odd_characters(pattern),
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def _library_split(pattern: str):
    """The library's own normaliser and split pattern, as the vocabulary file names them."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    clean = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
    return clean, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


@lru_cache
def odd_characters(pattern: str) -> str:
    """A pattern class of the characters that the library takes otherwise than Python.

    Unicode versions differ.  Every code point below UNTRIED is tried, by itself
    and twice between two letters; those from there on, which no version assigns
    or which aren't text, count as odd.
    """
    clean, split = _library_split(pattern)
    own, odd = _split_all(), []
    for lo in range(0, UNTRIED, 1 << 12):
        chars = [chr(c) for c in range(lo, lo + (1 << 12)) if not 0xD800 <= c < 0xE000 and chr(c) != "|"]
        theirs = clean.normalize_str("|".join(chars)).split("|")
        ours = [_lowered(unicodedata.normalize("NFC", c)) for c in chars]
        changed = {c for c, x, y in zip(chars, theirs, ours, strict=True) if x != y and y.strip(_SPACES)}
        probes = [f"a{x[:1] * 2}a" for x in theirs]
        begins = np.cumsum([0, *[len(p) + 1 for p in probes[:-1]]])
        line = " ".join(probes)
        found = [np.bincount(np.searchsorted(begins, np.array(at, np.int64), "right") - 1, minlength=len(probes)) for at in ([s for _, (s, _) in split.pre_tokenize_str(line)], [m.start() for m in own.finditer(line)])]
        odd += [ord(c) for k, c in enumerate(chars) if c in changed or found[0][k] != found[1][k]]
    odd = np.array([*odd, UNTRIED])
    first = odd[np.diff(odd, prepend=-2) != 1]
    last = [*odd[np.flatnonzero(np.diff(odd) != 1)].tolist(), 0x10FFFF]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last, strict=True)) + "]"


def _lowered(text: str) -> str:
    """Lower case letter by letter: a sigma at the end of a word is not a case of its own here."""
    return text.replace("Σ", "σ").lower()


class Merger:
    def __init__(self, model: dict):
        self.m = model
        self.known: dict[str, int] = {}
        self.special = re.compile("|".join(map(re.escape, model["special"]))) if model["special"] else None
        self.split_all = _split_all()
        self.odd = re.compile(model["odd"])
        self.clean, self.split = _library_split(model["pattern"])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.m["size"] + right
        i = np.minimum(np.searchsorted(self.m["keys"], key), len(self.m["keys"]) - 1)
        return np.where(self.m["keys"][i] == key, self.m["ranks"][i], _NONE)

    def surviving(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each (non-empty) word survive all merges."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(length) - length
        sym = self.m["inside"][raw]
        last = starts + length - 1
        sym[last] = self.m["ending"][raw[last]]
        word = np.repeat(np.arange(len(words)), length)
        out = np.zeros(len(words), np.int64)
        rank = np.full(len(sym), _NONE)
        fresh = np.ones(len(sym), bool)
        while len(sym):
            at = np.flatnonzero(fresh[:-1] & (word[:-1] == word[1:]))
            rank[fresh] = _NONE
            rank[at] = self._ranks(sym[at], sym[at + 1])
            first = np.flatnonzero(np.diff(word, prepend=-1))
            count = np.diff(first, append=len(sym))
            best = np.minimum.reduceat(rank, first)
            ended = best == _NONE
            out[word[first[ended]]] = count[ended]
            live = np.repeat(~ended, count)
            hit = live & (rank == np.repeat(best, count))
            # of places that overlap (a run of one symbol), every other one from the left
            run = np.flatnonzero(hit)
            if len(run):
                begins = np.flatnonzero(np.diff(run, prepend=-2) != 1)
                within = np.arange(len(run)) - np.repeat(begins, np.diff(begins, append=len(run)))
                run = run[within % 2 == 0]
            sym[run] = self.m["made"][rank[run]]
            live[run + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[run] = True
            before = run[run > 0] - 1
            changed[before] = True
            # the symbol before may itself be the right half of a merge
            halves = before[~live[before] & (before > 0)] - 1
            changed[halves] = True
            sym, word, rank, fresh = sym[live], word[live], rank[live], changed[live]
        return out

    def pretokens(self, text: str) -> list[str]:
        if text.isascii():
            return _SPLIT_1.findall(text.lower())
        if self.odd.search(text):
            return [w for w, _ in self.split.pre_tokenize_str(self.clean.normalize_str(text))]
        text = _lowered(unicodedata.normalize("NFC", text))
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_all.findall(text)
        return _SPLIT_1.findall(text)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        split: list[list[str]] = []
        for i, t in enumerate(texts):
            if self.special and "<|" in t:
                out[i] = len(self.special.findall(t))
                split.append(list(chain.from_iterable(map(self.pretokens, self.special.split(t)))))
            else:
                split.append(self.pretokens(t))
        new = list(set().union(*split).difference(self.known)) if split else []
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {}
                new = list(set().union(*split))
            self.known.update(zip(new, self.surviving([w.encode() for w in new]).tolist(), strict=True))
        get = self.known.__getitem__
        for i, s in enumerate(split):
            out[i] += sum(map(get, s))
        return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each document; ``path`` is a vocabulary file that the driver reads."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = docs.sparkSession.sparkContext.broadcast(load_merges(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(model.value)
        for batch in batches:
            texts = T.blobs(batch.column(1))
            n = [merger.counts([t.decode() for t in texts[i:j]]) for i, j in T.chunks(texts)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(np.concatenate([*n, np.zeros(0, np.int64)]))], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
