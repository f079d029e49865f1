"""Ids of whole texts by a tokenizers file whose pre-tokens end at white space.

For such a file (its normaliser works within a word and its pre-tokeniser drops
white space) a text's ids are those of its words, one after the other. A worker
keeps the ids of words it has met, up to a bound, so the library encodes each
only now and then. ``check_spacing`` proves on start that a file is of this kind.
"""

from __future__ import annotations

import json
import struct

import numpy as np

from .common import enter

#: Words and stems whose ids a worker keeps, and the longest word kept, in bytes.
CACHE_WORDS, CACHE_STEMS, CACHE_BYTES = 600_000, 400_000, 64
#: Bytes of text that are split into words at a time.
SPLIT_BYTES = 1 << 22

#: A punctuation mark that stands alone between words sent together, and how many go together.
MARK, RUN = "|", 500
#: The last character whose letters NFC and lower-casing map one to one; a tail
#: has no letter, number, space or apostrophe.
LAST = "ÿ"
TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: How byte-level files spell bytes: printable Latin-1 as itself, the rest from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b if b in _SHOWN else 256 + sum(c not in _SHOWN for c in range(b)) for b in range(256)}
PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            self.by_word = check_spacing(json.load(f))
        self.cache: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.model = self.lib.model
        alone = np.frombuffer(self._ask([MARK])[0], "<u4")
        self.mark = int(alone[0]) if len(alone) == 1 else None
        probe = ["straße", "ªµº", "can't.", "Édouà", "ABCdefthing", "ÿþñ", "x"]
        self.split = self.by_word and self.parts([w.encode() for w in probe]) == self._ask(probe)
        self.stems.clear()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Many go to the library in one text, kept apart by
        a mark of one id that none of them holds."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if MARK not in t] if self.mark is not None else []
        out: list = [None] * len(words)
        for lo in range(0, len(plain), RUN):
            run = plain[lo : lo + RUN]
            ids = np.array(self.lib.encode(f" {MARK} ".join([*[texts[i] for i in run], ""]), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            held = ids.tobytes()
            for i, a, b in zip(run, [0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True):
                out[i] = held[4 * a : 4 * b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._ask([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def parts(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, where a word of composed Latin letters and then
        punctuation is two pre-tokens: its stem in lower case, which many
        words share and the library's model takes as it is, and its tail."""
        stems, ask, out, whole = self.stems, self.model.tokenize, [], []
        for w in words:
            stem = w.rstrip(TAIL)
            if stem.isalpha():
                key = stem.lower()
            elif (text := stem.decode()).isalpha() and max(text) <= LAST:
                key = text.lower().encode()
            else:
                whole.append(len(out))
                out.append(w)
                continue
            ids = stems.get(key)
            if ids is None:
                got = [t.id for t in ask(key.decode() if key.isascii() else key.decode("latin-1").translate(BYTE_CHARS))]
                ids = stems[key] = PACK[len(got)](*got) if len(got) < len(PACK) else np.array(got, "<u4").tobytes()
            if len(stem) < len(w):
                tail = w[len(stem) :]
                more = stems.get(tail)
                if more is None:
                    more = stems[tail] = self.words([tail])[0]
                ids += more
            out.append(ids)
        for i, ids in zip(whole, self.words([out[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._ask([t.decode() for t in texts])
        cache, split = self.cache, [t.split() for t in texts]
        missing = [w for w in set().union(*split) if w not in cache]  # a difference would go over the whole cache
        long: dict[bytes, bytes] = {}
        for w, ids in zip(missing, (self.parts if self.split else self.words)(missing), strict=True):
            (cache if len(w) <= CACHE_BYTES else long)[w] = ids
        if long:
            out = [b"".join([cache[w] if w in cache else long[w] for w in ws]) for ws in split]
        else:
            out = [b"".join(map(cache.__getitem__, ws)) for ws in split]
        if len(cache) > CACHE_WORDS:
            cache.clear()
        if len(self.stems) > CACHE_STEMS:
            self.stems.clear()
        return out


def check_spacing(conf: dict) -> bool:
    """Whether a file's parts all work within words between ASCII white space."""
    norm = conf.get("normalizer") or {}
    norms = {n["type"] if n["type"] != "Replace" else (n["pattern"].get("Regex"), n["content"]) for n in norm.get("normalizers", [norm] if norm else [])}
    pre = conf.get("pre_tokenizer") or {}
    splits = [p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"]
    drops = any(p.get("invert") and p.get("behavior") == "Removed" and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in p["pattern"].get("Regex", "") for p in splits)
    added = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in conf.get("added_tokens", []))
    return bool(norms <= {"NFC", "Lowercase", (r"\s+", " ")} and drops and added)


_held: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, made once in each worker."""
    enter("word tokens", _held.clear)
    if path not in _held:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _held[path] = WordTokenizer(path)
    return _held[path]
