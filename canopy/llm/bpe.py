"""BPE encoding by a bounded-lookahead transducer, and decoding by an incremental state machine."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from struct import pack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import per_process, ship, small_batches

ship(__name__)

# The pre-tokenizer's pattern, and the characters that Unicode counts as white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: A merge's rank and product in one number.
BITS, NONE = 24, 1 << 60
LOW = (1 << BITS) - 1


def byte_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> dict:
    """What the transducer needs of a tokenizer file: tokens as bytes, merges as ids in their order, special tokens."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if raw.get("normalizer") or raw["pre_tokenizer"]["type"] != "ByteLevel" or raw["pre_tokenizer"]["add_prefix_space"] or raw["model"]["type"] != "BPE":
        raise ValueError("only byte-level BPE without normalizer and prefix space is known")
    chars = byte_chars()
    vocab = raw["model"]["vocab"]
    special = {t["content"]: t["id"] for t in raw["added_tokens"]}
    size = 1 + max([*vocab.values(), *special.values()])
    tokens = [b""] * size
    for t, i in vocab.items():
        tokens[i] = bytes(chars[c] for c in t)
    for t, i in special.items():
        tokens[i] = t.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in raw["model"]["merges"]]
    return {"tokens": tokens, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], "special": special, "bytes": [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])]}


def lookahead(tokens: list[bytes], merges: list[tuple[int, int, int]]) -> int:
    """Bytes right of a token's end that can decide whether it ends there.

    A merge (u, v) of rank r depends on v being there and free. What lies right of v can take it only by merges of a
    lower rank that have v as their left part, and can have formed it only by those that made it. reach[t] is how far
    right of t's left edge those merges look, so going through the ranks in order gives for each merge
    reach[v], and reach[u] and reach[uv] become at least len(u) + reach[v]. The largest is enough for all.
    """
    reach = [len(t) for t in tokens]
    most = max(reach, default=1)
    for u, v, uv in merges:
        far = len(tokens[u]) + reach[v]
        reach[u] = max(reach[u], far)
        reach[uv] = max(reach[uv], far)
        most = max(most, far)
    return most


class Transducer:
    """Encodes text; its memory is the tables, two bounded generations of words seen, and one window of bytes."""

    def __init__(self, model: dict, block: int = 512, words: int = 3 << 17):
        import regex

        self.tokens, self.first = model["tokens"], model["bytes"]
        self.rank = {(a, b): (r + 1 << BITS) | c for r, (a, b, c) in enumerate(model["merges"])}
        self.ahead = lookahead(model["tokens"], model["merges"])
        self.block, self.words = block, words
        self.special = model["special"]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.word_end = re.compile(f"(?<=[^{SPACE}])[{SPACE}]").search
        self.pieces = regex.compile(PIECES)
        self.hot: dict[str, bytes] = _Words(self)
        self.warm: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a whole piece: the merge of the lowest rank first, the leftmost of equals."""
        ids, rank = [self.first[b] for b in data], self.rank.get
        if len(ids) > 48:
            return self._merge_long(ids)
        ready = [rank(p, NONE) for p in zip(ids, ids[1:])]
        while ready and (least := min(ready)) < NONE:
            i, new = ready.index(least), least & LOW
            ids[i : i + 2] = [new]
            del ready[i]
            if i:
                ready[i - 1] = rank((ids[i - 1], new), NONE)
            if i < len(ready):
                ready[i] = rank((new, ids[i + 1]), NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked positions."""
        n, rank = len(ids), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j, new = after[i], r & LOW
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := rank.get((new, ids[after[i]])):
                    heapq.heappush(heap, (r, i, new, ids[after[i]]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], new))):
                heapq.heappush(heap, (r, h, ids[h], new))
        return [t for t, x in zip(ids, alive) if x]

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that comes in parts, each as soon as no later byte can change it.

        The window holds the bytes not yet emitted. A token that ends at least `ahead` bytes before the window's end is
        stable; what follows a token's end is encoded like a text of its own, so the window moves on from there.
        """
        window = b""
        for part in data:
            for k in range(0, len(part), self.block):
                window += part[k : k + self.block]
                if len(window) < self.ahead + self.block:
                    continue
                end = 0
                for t in self.merge(window):
                    if end + len(self.tokens[t]) + self.ahead > len(window):
                        break
                    end += len(self.tokens[t])
                    yield t
                window = window[end:]
        yield from self.merge(window)

    def piece(self, text: str) -> Iterator[int]:
        """Ids of a piece. One that ends inside its first window has nothing to look ahead to and is merged at once."""
        if len(text) * 4 <= self.block:
            return iter(self.merge(text.encode()))
        return self.stream(text[k : k + self.block].encode() for k in range(0, len(text), self.block))

    def packed(self, chunk: str) -> bytes:
        """Ids of a chunk between blanks, as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        for piece in (chunk,) if chunk.isspace() else self.pieces.findall(chunk):
            out += self.piece(piece)
        return pack(f"<{len(out)}I", *out)

    def parts(self, text: str, start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
        """Cuts of text[start:stop] of about `size` characters, each at the end of a word, where chunks end in any text."""
        while start < stop:
            found = self.word_end(text, start + size, stop) if stop - start > size else None
            end = found.start() if found else stop
            yield start, end
            start = end

    def encode(self, text: str, size: int = 1 << 15) -> Iterator[bytes]:
        """Packed ids of the text, some thousand at a time: beside the text itself, what is held does not grow with it.
        Special tokens' strings become their ids."""
        start = 0
        for cut in chain(self.cut.finditer(text) if self.cut else (), (None,)):
            for a, b in self.parts(text, start, len(text) if cut is None else cut.start(), size):
                if b - a <= 2 * size:
                    yield b"".join(map(self.hot.__getitem__, self.chunks(text[a:b])))
                else:  # a word without end, with what stands before it
                    yield from self.long(text, a, b, size)
            if cut is not None:
                yield self.special[cut[0]].to_bytes(4, "little")
                start = cut.end()

    def long(self, text: str, start: int, stop: int, size: int) -> Iterator[bytes]:
        """As encode, piece by piece: for stretches whose words are longer than a part. A piece's end sees the stretch's end only."""
        ids = chain.from_iterable(self.piece(m[0]) for m in self.pieces.finditer(text, start, stop))
        while some := list(islice(ids, size)):
            yield pack(f"<{len(some)}I", *some)


class _Words(dict):
    """Words to packed ids. When full, the words become the older generation and those still in use move back."""

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        o = self.owner
        got = o.warm.get(chunk)
        if got is None:
            got = o.packed(chunk)
        if len(chunk) <= 64:
            if len(self) >= o.words:
                o.warm = dict(self)
                self.clear()
            self[chunk] = got
        return got


class Decoder:
    """Ids to text: tokens give bytes, and the bytes of an unfinished character wait for the next call.

    Bytes that are no UTF-8 become U+FFFD, one for each longest invalid run.
    """

    def __init__(self, tokens: list[bytes]):
        self.at = tokens.__getitem__
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], end: bool = False) -> str:
        return self.state.decode(b"".join(map(self.at, ids)), end)


def _digests(shared, texts: Iterable):
    import numpy as np
    import pandas as pd

    t = per_process(("bpe", shared.value["version"]), lambda: Transducer(shared.value))
    for batch in texts:
        rows = []
        for text in batch:
            ids, words, dec, n = hashlib.sha256(), hashlib.sha256(), Decoder(t.tokens), 0
            for packed in t.encode(text or ""):
                ids.update(packed)
                n += len(packed) // 4
                for k in range(0, len(packed), 1 << 16):
                    words.update(dec.feed(np.frombuffer(packed[k : k + (1 << 16)], "<u4").tolist()).encode())
            words.update(dec.feed((), True).encode())
            rows.append((n, ids.hexdigest(), words.hexdigest()))
        yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def _share(docs: DataFrame, path: str):
    model = load(path)
    model["version"] = hashlib.sha256(repr((model["merges"], model["special"])).encode()).hexdigest()
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model)  # as large as the tokenizer file


def encode(docs: DataFrame, path: str, out: str = "ids", text_col: str = "text") -> DataFrame:
    """docs with the token ids of text_col in `out` (replaced if there); a null text is empty."""
    import pandas as pd

    shared = _share(docs, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        t = per_process(("bpe", shared.value["version"]), lambda: Transducer(shared.value))
        for batch in batches:
            yield pd.Series([np.frombuffer(b"".join(t.encode(x or "")), "<u4").astype("int32") for x in batch])

    return docs.withColumn(out, F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR_ITER)(F.col(text_col)))


def decode(docs: DataFrame, path: str, out: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the text of ids_col in `out` (replaced if there); null ids give the empty text."""
    import pandas as pd

    shared = _share(docs, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = shared.value["tokens"]
        for batch in batches:
            texts = []
            for ids in batch:
                d = Decoder(tokens)
                ids = [] if ids is None else ids.tolist()
                texts.append("".join(d.feed(ids[k : k + (1 << 14)]) for k in range(0, len(ids), 1 << 14)) + d.feed((), True))
            yield pd.Series(texts, dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(ids_col)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded and decoded again piece by piece in one
    worker, so that no ids travel. Null texts are empty; other columns are ignored; an empty table gives no rows."""
    import pandas as pd

    shared = _share(docs, path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _digests(shared, batches)

    made = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string", F.PandasUDFType.SCALAR_ITER)
    return docs.select(F.col(id_col).alias("doc_id"), made(F.col(text_col)).alias("_d")).select("doc_id", "_d.*")
