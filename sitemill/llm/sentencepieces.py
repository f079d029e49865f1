"""SentencePiece BPE, encoded and decoded by vectorised merge rounds.

A piece never holds a space sign behind another character, so no merge crosses
from a character to a following space sign; nor does one touch a character of
no piece, such as a line feed. Texts are cut there into words, and only words
that the worker has not met lately are encoded, many at once: their symbols
lie in one flat array, every round finds each word's best pair by a segmented
minimum, merges its leftmost occurrences and closes the gaps, until no pair
remains. The library's result is a queue's, best score first, then leftmost.
Merging all occurrences at once gives the same unless the merged piece begins
or ends another piece of at least its score; then a round merges just the
leftmost one. A round goes over all symbols of its words, so a word of over
``LONG_WORD`` characters (text without spaces) would take the square of its
length: such a word goes through a queue of its own, in n log n, to the same ids.

Null texts count as empty, and an empty text has just the begin and end ids.
Repeated rows give repeated rows, an empty table none. Only ``id_col`` and
``text_col`` are read, so other columns can't clash; an id may be null. A long
text is encoded whole, a word of it at a time in memory some 200 times the word.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import enter, text_chunks

SPACE = "▁"
#: Words whose ids a worker keeps, and the longest word kept, in characters.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Characters of a word up to which it takes part in rounds.
LONG_WORD = 2048
NEVER = np.int32(2**31 - 1)


class PieceModel:
    """Tables of a byte-fallback BPE model file, and its encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.is_special = np.array(special)
        self.byte_ids = np.zeros(256, np.int64)
        normal = {}
        for i, piece in enumerate(pieces):
            if self.is_byte[i]:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not special[i]:
                normal[piece] = i
        #: Symbols: piece ids, then characters that only occur inside pieces, then ``other`` + code point.
        inner = sorted({c for p in normal for c in p} - set(normal))
        symbols = normal | {c: n + k for k, c in enumerate(inner)}
        self.other = n + len(inner)
        self.inner = inner
        self.n_pieces = n
        self.char_symbol = {ord(c): s for c, s in symbols.items() if len(c) == 1}
        self._pages = np.arange(self.other, self.other + 0x110000, dtype=np.int32)
        for cp, s in self.char_symbol.items():
            self._pages[cp] = s
        scores = {p: lib.get_score(i) for p, i in normal.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                if piece[:cut] in symbols and piece[cut:] in symbols:
                    pairs.append((symbols[piece[:cut]], symbols[piece[cut:]], i, order[scores[piece]]))
        table = np.array(pairs, np.int64).reshape(-1, 4)
        key = table[:, 0] * self.other + table[:, 1]
        by = np.argsort(key)
        self.keys, self.into, self.rank = key[by], table[by, 2].astype(np.int32), table[by, 3].astype(np.int32)
        #: Pieces that a merge may turn at once into one of at least their score.
        own = np.full(self.other, NEVER, np.int64)
        for p, i in normal.items():
            own[i] = order[scores[p]]
        self.unsafe = np.zeros(self.other, bool)
        for side in (0, 1):
            hit = table[:, 3] <= own[table[:, side]]
            self.unsafe[table[hit, side]] = True
        self.spacing = re.compile(f"{SPACE}+[^{SPACE}\\n]*|\\n[^{SPACE}\\n]*|[^{SPACE}\\n]+") if ord("\n") not in self.char_symbol else None
        self.surface = [
            b"" if special[i] else bytes([int(p[3:5], 16)]) if self.is_byte[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.surface[self.unk] = " ⁇ ".encode()
        self.cache: dict[str, bytes] = {}
        self._table: dict[int, int] = {}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs of symbols; NEVER where none."""
        at = np.minimum(np.searchsorted(self.keys, key := np.where((left < self.other) & (right < self.other), left.astype(np.int64) * self.other + right, -1)), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], NEVER), np.where(hit, self.into[at], 0)

    def merge(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words of symbols, all beginning at ``starts``, to the end.

        Returns the symbols that remain and where each word begins in them
        (with the total behind the last). No word is empty.
        """
        n_words = len(starts)
        word_of = np.repeat(np.arange(n_words), np.diff(np.append(starts, len(symbols))))
        done_sym, done_word = [], []
        rank = np.full(len(symbols), NEVER, np.int32)
        into = np.zeros(len(symbols), np.int32)
        fresh = np.flatnonzero(word_of[1:] == word_of[:-1])
        rank[fresh], into[fresh] = self._look(symbols[fresh], symbols[fresh + 1])
        while len(symbols):
            heads = np.flatnonzero(np.concatenate(([True], word_of[1:] != word_of[:-1])))
            sizes = np.diff(np.append(heads, len(symbols)))
            best = np.minimum.reduceat(rank, heads)
            ended = np.repeat(best == NEVER, sizes)
            if ended.any():
                done_sym.append(symbols[ended])
                done_word.append(word_of[ended])
                live = ~ended
                symbols, word_of, rank, into = symbols[live], word_of[live], rank[live], into[live]
                sizes, best = sizes[best != NEVER], best[best != NEVER]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # leftmost without overlap: every other one of a run of neighbours
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            of = word_of[at]
            head = np.concatenate(([True], of[1:] != of[:-1]))
            at = at[head | ~self._risky(into, at, head)]
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word_of, rank, into = symbols[keep], word_of[keep], rank[keep], into[keep]
            new = moved[at]
            touched = np.union1d(new, new[new > 0] - 1)
            rank[touched] = NEVER
            inside = touched[touched + 1 < len(symbols)]
            inside = inside[word_of[inside] == word_of[inside + 1]]
            rank[inside], into[inside] = self._look(symbols[inside], symbols[inside + 1])
        if not done_sym:
            return symbols, np.zeros(1, np.int64)
        out, word = np.concatenate(done_sym), np.concatenate(done_word)
        by = np.argsort(word, kind="stable")
        return out[by], np.searchsorted(word[by], np.arange(n_words + 1))

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one word, by a queue of pairs: best rank first, then
        leftmost; symbols are linked, so a merge touches its neighbours alone."""
        if not self._table:
            packed = self.rank.astype(np.int64) << 32 | self.into
            self._table = dict(zip(self.keys.tolist(), packed.tolist(), strict=True))
        n, other, look, never = len(symbols), self.other, self._table.get, int(NEVER)
        rank, _ = self._look(symbols[:-1], symbols[1:])
        at = np.flatnonzero(rank != NEVER)
        queue = (rank[at].astype(np.int64) << 32 | at).tolist()
        heapq.heapify(queue)
        held, ahead, behind = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        best = [*rank.tolist(), never]  # rank of the pair that begins at each place, -1 where none is left

        def renew(i: int, j: int) -> None:
            a, b = held[i], held[j]
            found = look(a * other + b, -1) if a < other and b < other else -1
            best[i] = never if found < 0 else found >> 32
            if found >= 0:
                heapq.heappush(queue, found >> 32 << 32 | i)

        while queue:
            first = heapq.heappop(queue)
            i = first & 0xFFFFFFFF
            if best[i] != first >> 32:
                continue
            j = ahead[i]
            k = ahead[j]
            held[i] = look(held[i] * other + held[j]) & 0xFFFFFFFF
            best[j], ahead[i] = -1, k
            if k < n:
                behind[k] = i
                renew(i, k)
            else:
                best[i] = never
            if behind[i] >= 0:
                renew(behind[i], i)
        out, i = [], 0
        while i < n:
            out.append(held[i])
            i = ahead[i]
        return np.array(out, np.int32)

    def _risky(self, into: np.ndarray, at: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Whether any merge of the word in this round makes an unsafe piece."""
        unsafe = self.unsafe[into[at]]
        if not unsafe.any():
            return unsafe
        begins = np.flatnonzero(head)
        return np.repeat(np.logical_or.reduceat(unsafe, begins), np.diff(np.append(begins, len(at))))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        whole = "".join(words)
        if not whole:
            return [b""] * len(words)
        symbols = self._pages[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        full = np.flatnonzero(sizes)
        long = sizes[full] > LONG_WORD
        if long.any():
            whole = [None] * len(full)
            for k in np.flatnonzero(long).tolist():
                whole[k] = self._merge_long(symbols[ends[full[k]] - sizes[full[k]] : ends[full[k]]])
            rest = np.flatnonzero(~long)
            if len(rest):
                own = np.concatenate([symbols[ends[w] - sizes[w] : ends[w]] for w in full[rest].tolist()])
                merged, at = self.merge(own, np.cumsum(sizes[full[rest]]) - sizes[full[rest]])
                for k, a, b in zip(rest.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    whole[k] = merged[a:b]
            merged, at = np.concatenate(whole), np.cumsum([0, *map(len, whole)])
        else:
            merged, at = self.merge(symbols, (ends - sizes)[full])
        out = [b""] * len(words)
        plain = merged < self.n_pieces
        odd = set(np.searchsorted(at, np.flatnonzero(~plain), "right").tolist()) if not plain.all() else ()
        held, at = merged.astype("<u4").tobytes(), at.tolist()
        for k, w in enumerate(full.tolist()):
            if k + 1 in odd:
                ids = []
                for s in merged[at[k] : at[k + 1]].tolist():
                    if s < self.n_pieces:
                        ids.append(s)
                    else:
                        c = chr(s - self.other) if s >= self.other else self.inner[s - self.n_pieces]
                        ids += self.byte_ids[list(c.encode("utf-8"))].tolist()
                out[w] = np.array(ids, "<u4").tobytes()
            else:
                out[w] = held[4 * at[k] : 4 * at[k + 1]]
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text, each with its own space sign or line feed."""
        if not text:
            return []
        text = f"{SPACE}{text}".replace(" ", SPACE)
        return self.spacing.findall(text) if self.spacing else re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts without begin and end, as 32-bit integers."""
        cache, split = self.cache, [self.words(t) for t in texts]
        missing = [w for w in set().union(*split) if w not in cache]  # a difference would go over the whole cache
        long = {}
        if missing:
            for w, ids in zip(missing, self.encode_words(missing), strict=True):
                (cache if len(w) <= CACHE_CHARS else long)[w] = ids
        if long:
            out = [b"".join([cache[w] if w in cache else long[w] for w in ws]) for ws in split]
        else:
            out = [b"".join(map(cache.__getitem__, ws)) for ws in split]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: special ids give nothing, the first space sign is
        the added one, and every byte outside whole UTF-8 becomes U+FFFD."""
        ids = np.asarray(ids, np.int64)
        special = np.flatnonzero(self.is_special[ids])
        if len(special) and np.any((special > 0) & (special < len(ids) - 1)):
            return self._decode_bytes(ids.tolist())
        shown = ids[~self.is_special[ids] | (ids == self.unk)].tolist()
        raw = b"".join(map(self.surface.__getitem__, shown))
        if shown and raw[:1] == b" " and shown[0] != self.unk and not self.is_byte[shown[0]]:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_bytes(shown)

    def _decode_bytes(self, shown: list[int]) -> str:
        out, run = [], bytearray()

        def close() -> None:
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode())
                        del run[:size]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[0]

        first = True
        for i in shown:
            if self.is_byte[i]:
                run += self.surface[i]
                first = False
                continue
            close()
            text = self.surface[i].decode()
            out.append(text[1:] if first and i != self.unk and text[:1] == " " else text)
            first = first and bool(self.is_special[i]) and i != self.unk
        close()
        return "".join(out)


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of a file, made once in each worker."""
    enter("pieces", _models.clear)
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_decode(docs: DataFrame, model_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts with begin and end ids and decodes the ids again.

    One narrow map, no shuffle. Returns ``doc_id, n_tokens, ids`` (32-bit
    little-endian) and ``decoded``, or with ``digest`` their SHA-256 in hex in
    place of both (``ids_sha256, decoded_sha256``). ``model_path`` must exist
    on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (model.bos, model.eos))
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                counts, firsts, seconds = [], [], []
                for ids in model.encode([t.decode() for t in chunk.rows()]):
                    ids = begin + ids + end
                    text = model.decode(np.frombuffer(ids, "<u4"))
                    counts.append(len(ids) // 4)
                    firsts.append(hashlib.sha256(ids).hexdigest() if digest else ids)
                    seconds.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.lo, len(chunk)), pa.array(counts, pa.int64()), pa.array(firsts, pa.string() if digest else pa.binary()), pa.array(seconds, pa.string())],
                    ["doc_id", "n_tokens", *(x.split()[0] for x in tail.split(", "))],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, {tail}")
