"""Operator 4: token counts by a compiled finite-state transducer.

A BPE vocabulary is compiled, lazily, into a deterministic transducer over byte symbols. A state holds
the longest suffix of the input that can still begin a token, with the last token and the relative token
count of every position inside it; a transition carries the number of tokens that it adds (possibly none,
or less than none where a longer token replaces two). The tokens that end at a position are fixed by the
rule that each neighbouring pair of tokens must itself be a valid encoding.

White space resets the transducer, so the state map of a chunk of text is (head, count, tail): the text
before its first white space, the tokens between its first and its last, and the text after. Such maps
compose associatively. A long text is cut into chunks that are counted on their own, by as many tasks as there are,
and their maps are composed in rounds, a fixed number of neighbours at a time: a parallel scan, of which the last
value is asked for.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD_END = "</w>"
#: Characters that Python's str.split() takes for white space and Unicode's White_Space property doesn't.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\s")
MEMO = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Text:
    """How the vocabulary file prepares text: special strings, normal form, pretokens."""

    def __init__(self, spec: dict):
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not supported")
        self.special_ids = {t["content"]: t["id"] for t in added}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.special_ids, key=len, reverse=True)))) if added else None
        self.sign = os.path.commonprefix(list(self.special_ids))
        if self.steps(spec["normalizer"], "normalizers") != ["NFC", ("Replace", r"\s+", " "), "Lowercase"]:
            raise ValueError("normal forms other than NFC, white space and lower case are not supported")
        split, *rest = self.steps(spec["pre_tokenizer"], "pretokenizers")
        if rest != ["ByteLevel"] or split[::2] != ("Split", ("Removed", True)) or spec["model"]["type"] != "BPE" or spec["model"]["end_of_word_suffix"] != WORD_END:
            raise ValueError("vocabularies other than byte-level pairs with word ends, split by one pattern, are not supported")
        self.pieces = regex.compile(split[1])

    @staticmethod
    def steps(spec: dict, inner: str) -> list:
        """What each step of a sequence is and does."""
        out = []
        for x in spec[inner] if spec["type"] == "Sequence" else [spec]:
            pattern = x.get("pattern", {}).get("Regex")
            out.append(x["type"] if pattern is None else (x["type"], pattern, x["content"] if "content" in x else (x["behavior"], x["invert"])))
        return out

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """(normalised part, False) and (special string, True) in turn."""
        at = 0
        if self.special is not None and self.sign in text:
            for m in self.special.finditer(text):
                yield self.normal(text[at : m.start()]), False
                yield m[0], True
                at = m.end()
        yield self.normal(text[at:] if at else text), False

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Parts of normalised text that no pretoken crosses."""
        return regex.split(r"\s+", text) if NOT_SPACE.search(text) else text.split()


class Transducer:
    """Token counts of pretokens, as a lazily determinised transducer."""

    def __init__(self, vocab: dict[str, int], merges: list):
        names = byte_symbols()
        inner = {n: chr(b) for b, n in enumerate(names)}
        final = {n + WORD_END: chr(256 + b) for b, n in enumerate(names)}
        code = {**inner, **final}
        self.rank: dict[tuple[str, str], int] = {}
        self.tokens: set[str] = {s for n, s in code.items() if n in vocab}
        for i, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y = code[a], code[b]
            code.setdefault(a + b, x + y)
            self.rank.setdefault((x, y), i)
            self.tokens.add(x + y)
        self.longest = max(map(len, self.tokens))
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))} | {""}
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ("", (None,), (0,))
        self.ids, self.states, self.moves = {start: 0}, [start], [{}]

    def merge(self, text: str) -> list[str]:
        """The tokens of a short string of symbols, merge by merge."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def pair(self, a: str, b: str) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """Next state, and tokens added."""
        head, last, counts = self.states[state]
        text = head + chr(symbol)
        for size in range(min(len(text), self.longest), 0, -1):
            token, at = text[len(text) - size :], len(text) - size
            if token in self.tokens and (last[at] is None or self.pair(last[at], token)):
                break
        else:
            raise ValueError(f"no token ends with {symbol!r}")
        added = counts[at] + 1
        last, counts = (*last, token), (*counts, added)
        keep = next(n for n in range(min(len(text), self.longest - 1), -1, -1) if text[len(text) - n :] in self.prefixes or n == 0)
        new = (text[len(text) - keep :] if keep else "", last[-keep - 1 :], tuple(c - added for c in counts[-keep - 1 :]))
        target = self.ids.get(new)
        if target is None:
            target = self.ids[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][symbol] = target, added
        return target, added

    def count(self, pretoken: str) -> int:
        """Tokens of one pretoken; the last byte is read as a word end."""
        if len(self.states) > MEMO:
            self.reset()
        raw, state, total, moves = pretoken.encode("utf-8", "replace"), 0, 0, self.moves
        for symbol in (*raw[:-1], raw[-1] + 256):
            hit = moves[state].get(symbol)
            if hit is None:
                hit = self.move(state, symbol)
            state = hit[0]
            total += hit[1]
        return total


class ChunkMap(NamedTuple):
    """What a chunk does to the transducer: head (whole chunk, if it has no white space), count, tail (None then)."""

    head: str
    count: int
    tail: str | None


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.text = Text(spec)
        self.machine = Transducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.memo: dict[str, int] = {}

    def chunk(self, chunk: str) -> int:
        n = self.memo.get(chunk)
        if n is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            n = self.machine.count(chunk) if chunk.isalpha() else sum(map(self.piece, self.text.pieces.findall(chunk)))
            self.memo[chunk] = n
        return n

    def piece(self, piece: str) -> int:
        return self.memo.get(piece) or self.machine.count(piece)

    def chunk_map(self, text: str) -> ChunkMap:
        parts = regex.split(r"\s+", text) if NOT_SPACE.search(text) else (text.split() if text else [""])
        if not parts:  # white space only
            return ChunkMap("", 0, "")
        if parts[0] and SPACE.match(text):
            parts.insert(0, "")
        if parts[-1] and SPACE.match(text[-1]):
            parts.append("")
        if len(parts) == 1:
            return ChunkMap(parts[0], 0, None)
        return ChunkMap(parts[0], sum(self.chunk(w) * n for w, n in Counter(parts[1:-1]).items()), parts[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return ChunkMap(a.head, a.count, a.tail + b.head)
        return ChunkMap(a.head, a.count + self.chunk(a.tail + b.head) + b.count, b.tail)

    def count(self, text: str, chunk_chars: int = 1 << 16) -> int:
        total = 0
        for part, special in self.text.parts(text):
            if special:
                total += 1
            elif len(part) <= chunk_chars:
                total += sum(self.chunk(w) * n for w, n in Counter(self.text.chunks(part)).items())
            else:
                maps = (self.chunk_map(part[i : i + chunk_chars]) for i in range(0, len(part), chunk_chars))
                *_, whole = accumulate(maps, self.compose)
                total += whole.count + self.chunk(whole.head) + self.chunk(whole.tail or "")
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


#: Neighbouring maps that one step of the scan composes.
FAN = 64
MAPS = "key long, part int, at long, head string, count long, tail string"


def long_texts(rows: DataFrame, path: str, chunk_chars: int) -> DataFrame:
    """(key, n_tokens) of texts (key, text): normalised and cut by one task each, counted and composed by many.

    A chunk's map has to hold what stands before its first and after its last white space, so a text without any
    white space is held whole in the end.
    """

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = counter(path).text.parts
        for b in batches:
            for key, text in zip(b["key"].tolist(), b["text"], strict=True):
                for n, (part, special) in enumerate(parts(text)):
                    ends = [None] if special else range(0, max(len(part), 1), chunk_chars)
                    for at, i in enumerate(ends):
                        yield pd.DataFrame({"key": [key], "part": [n], "at": [at], "text": ["" if special else part[i : i + chunk_chars]], "extra": [int(special)]})

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for b in batches:
            found = [count.chunk_map(t) for t in b["text"]]
            yield b[["key", "part", "at"]].assign(head=[m.head for m in found], count=[m.count + e for m, e in zip(found, b["extra"], strict=True)], tail=[m.tail for m in found])

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows, count = rows.sort_values("at"), counter(path)
        *_, whole = accumulate((ChunkMap(h, int(n), t) for h, n, t in zip(rows["head"], rows["count"], rows["tail"], strict=True)), count.compose)
        first = rows.iloc[0]
        return pd.DataFrame({"key": [first["key"]], "part": [first["part"]], "at": [first["at"] // FAN], "head": [whole.head], "count": [whole.count], "tail": [whole.tail]})

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = counter(path).chunk
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "n_tokens": [int(n) + chunk(h) + chunk(t or "") for h, n, t in zip(b["head"], b["count"], b["tail"], strict=True)]})

    chunks = rows.mapInPandas(cuts, "key long, part int, at long, text string, extra int").repartition("key", "part", "at")
    found = cut(chunks.mapInPandas(maps, MAPS), "chunk-maps")
    most = (found.agg(F.max("at").alias("n")).first()["n"] or 0) + 1
    while most > 1:
        found = found.groupBy("key", "part", F.floor(F.col("at") / F.lit(FAN)).alias("to")).applyInPandas(compose, MAPS)
        most = -(-most // FAN)
    return found.mapInPandas(close, "key long, n_tokens long").groupBy("key").agg(F.sum("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, chunk_chars: int = 1 << 16, long_chars: int = 1 << 20) -> DataFrame:
    """Tokens of each whole text: (doc_id, n_bytes, n_tokens, over_limit).

    A null text counts as empty (no bytes, no tokens, not over the limit); a null doc_id stays null, repeated
    rows give repeated results, an empty table gives none, and further columns are ignored. Texts up to
    ``long_chars`` characters are counted where they lie, without any exchange; longer ones by the scan of their chunks.
    """
    path = vocabulary or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path).count
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": pd.Series([count(t, chunk_chars) for t in b["text"]], dtype="int64")})

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = dict(rows.dtypes)["doc_id"]
    long = F.length("text") > long_chars
    out = rows.where(~long).mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    some = cut(rows.where(long).withColumn("key", F.monotonically_increasing_id()), "long-texts")  # written: keys stay as they are
    if not some.isEmpty():
        out = out.union(some.select("key", "doc_id", "n_bytes").join(long_texts(some.select("key", "text"), path, chunk_chars), "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
