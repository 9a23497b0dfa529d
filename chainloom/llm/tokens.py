"""Exact, cached encoding of whole texts with a ``tokenizers`` vocabulary file.

Both supported kinds split a text into pieces that are encoded independently of
each other, so the ids of a text are those of its pieces in order.  Pieces not
met before have the vocabulary's merges applied to thousands at a time; those
that the library might split further are joined, encoded in one call and taken
apart again, or encoded one by one.  Texts in which Python's and the library's
notion of white space differ, or that hold a special token's spelling, are
encoded directly.  Ids are little-endian uint32.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .common import dropped_by

#: White space of Python that the library doesn't count as such.
ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: All other white space but blank and line feed.
RARE_SPACE = "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that every library counts as such.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]*")
#: Pieces that are joined for one call.
GROUP = 300


def _pack(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class Merges:
    """A BPE model's merges, applied to many words at once: in each the pair of least rank, the leftmost of equals, until none is left."""

    #: Words of one step, of about equal length: its tables stay in the processor's caches.
    STEP = 4096
    #: Bytes of a word with what is put before it, as places take six bits; longer words go to the library.
    LONGEST = 62
    NONE = 1 << 30
    SLOTS = 1 << 20

    @staticmethod
    def fit(model: dict) -> bool:
        """Whether the model does nothing but merge."""
        return not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))

    def __init__(self, model: dict):
        from tokenizers.pre_tokenizers import ByteLevel

        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        # The library's letters for bytes: printable ones stand for themselves, the others follow from 256 on in order.
        alphabet = set(ByteLevel.alphabet())
        rest = iter(range(256, 512))
        letters = [chr(b) if chr(b) in alphabet else chr(next(rest)) for b in range(256)]
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        self.outside = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int32) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # One table for all pairs: a left id's row starts at a place where all its right ids fall on free slots.
        self.base, self.owner, self.rank = np.zeros(self.outside + 1, np.int32), np.full(self.SLOTS + self.outside + 1, -1, np.int32), np.zeros(self.SLOTS + self.outside + 1, np.int32)
        order = np.argsort(left, kind="stable")
        rows = np.split(order, np.flatnonzero(np.diff(left[order])) + 1)
        draw = np.random.default_rng(0)
        for row in sorted(rows, key=len, reverse=True):
            at = right[row]
            while (self.owner[at + (start := int(draw.integers(self.SLOTS)))] >= 0).any():
                pass
            self.base[left[row[0]]] = start
            self.owner[at + start], self.rank[at + start] = left[row[0]], row

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.base[a] + b
        return np.where(self.owner[at] == a, self.rank[at] << 6, self.NONE)

    def encode(self, words: list[str], before: str = "") -> list[bytes]:
        """Ids of each word (not empty, no line feed in it), with ``before`` put before it, as one piece."""
        text = np.frombuffer((before + f"\n{before}".join(words) + "\n").encode(), np.uint8)
        ends = np.flatnonzero(text == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        out, order = [None] * len(words), np.argsort(ends - starts, kind="stable")
        for lo in range(0, len(order), self.STEP):
            group = order[lo : lo + self.STEP]
            made, n = self._step(text, starts[group], (ends - starts)[group])
            cuts, made = np.concatenate([[0], 4 * np.cumsum(n)]).tolist(), made.astype("<u4").tobytes()
            for k, a, b in zip(group.tolist(), cuts, cuts[1:]):
                out[k] = made[a:b]
        return out

    def _step(self, text, starts, lengths):
        """All ids in order, and their number for each word.  Row 0 of the tables and what follows a word are outside of it."""
        n, height = len(starts), int(lengths.max()) + 2
        ids = np.full((height, n), self.outside, np.int32)
        for j in range(height - 2):
            here = slice(int(np.searchsorted(lengths, j, "right")), n)  # the words longer than j: lengths ascend
            ids[j + 1, here] = self.first[text[starts[here] + j]]
        ids[lengths, np.arange(n)] = self.last[text[starts + lengths - 1]]
        best = np.full((height, n), self.NONE, np.int32)
        best[:-1] = self.ranks(ids[:-1], ids[1:]) + np.arange(height - 1, dtype=np.int32)[:, None]
        flat, best_flat = ids.reshape(-1), best.reshape(-1)
        after, ahead = np.arange(n, (height + 1) * n, dtype=np.int32), np.arange(-n, (height - 1) * n, dtype=np.int32)
        while True:
            least = best.min(0)
            words = np.flatnonzero(least < self.NONE)
            if not len(words):
                break
            least = least[words]
            at = (least & 63) * n + words
            gone, made = after[at], self.made[least >> 6]
            end, start = after[gone], ahead[at]
            flat[at], flat[gone] = made, -1
            after[at], ahead[end] = end, at
            best_flat[gone] = self.NONE
            best_flat[at] = self.ranks(made, flat[end]) + (least & 63)
            best_flat[start] = self.ranks(flat[start], made) + start // n
        held = ((ids >= 0) & (ids < self.outside)).T
        return ids.T[held], held.sum(1)


def gaps_of(made: list) -> list[int]:
    """Where None stands."""
    out, at = [], -1
    try:
        while True:
            at = made.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class Encoder:
    """Common part: the cache and the direct way."""

    #: Pieces of a generation; a worker holds two, and what is met again moves to the younger one.
    most = 500_000

    def __init__(self, tokenizer, specials: list[str], model: dict):
        self.merges = Merges(model) if Merges.fit(model) else None
        self.tokenizer, self.pieces, self.older, self.direct_only = tokenizer, {}, {}, [*ODD_SPACE, *specials]

    def direct(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def split(self, text: str) -> list[str] | None:
        """Keys of pieces in order; None: encode the text directly."""
        raise NotImplementedError

    def learn(self, missing: set[str]) -> None:
        raise NotImplementedError

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > self.most:
            self.pieces, self.older = {}, self.pieces
        parts = [None if any(x in t for x in self.direct_only) else self.split(t) for t in texts]
        made = [p and list(map(self.pieces.get, p)) for p in parts]
        gaps = [(m, p, at) for m, p in zip(made, parts) if m and (at := gaps_of(m))]
        if gaps:
            missing = {p[i] for _, p, at in gaps for i in at}
            again = {p: self.older[p] for p in missing if p in self.older}
            self.pieces.update(again)
            self.learn(missing.difference(again))
            for m, p, at in gaps:
                for i in at:
                    m[i] = self.pieces[p[i]]
        return [self.direct(t) if m is None else b"".join(m) for t, m in zip(texts, made)]


class ByteLevelEncoder(Encoder):
    """Byte-level BPE.

    A text whose only white space is single blanks and single line feeds falls
    apart into words with the separator before each.  Keys: ``word`` stands for
    blank and word, ``\\nword`` for line feed and word.  The first word, and
    other texts, go through the general pattern, whose keys end in ``\\n\\n``.
    """

    most = 300_000
    PIECE = re.compile(r" ?\S+|\s+(?!\S)|\s")

    def __init__(self, tokenizer, specials, model):
        super().__init__(tokenizer, specials, model)
        (self.line_end,) = tokenizer.encode("\n", add_special_tokens=False).ids
        self.tails = {c: self.direct(c) for c in ",.;:!?"}

    def split(self, text):
        if text and not (text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or any(c in text for c in RARE_SPACE)):
            words = text.replace("\n", " \n").split(" ")
            words[0] += "\n\n"
            return words
        return [p + "\n\n" for p in self.PIECE.findall(text)]

    #: Letters that every library counts as such, then symbols: two runs that are encoded apart.  Their bytes are ``Merges.LONGEST`` at most.
    WORD = re.compile("(\n)?([A-Za-zÀ-ÖØ-öø-ÿ]{1,30})([!-&(-/:-@\\[-`{-~]{1,60})?(\n\n)?")

    @staticmethod
    def plain(words) -> set[str]:
        """Those of words made of letters that ``WORD`` takes without a line feed or symbols."""
        words = {w for w in words if len(w) <= 30}
        return words if PLAIN.fullmatch("".join(words)) else {w for w in words if PLAIN.fullmatch(w)}

    def learn(self, missing):
        pieces, line_end, match = self.pieces, _pack([self.line_end]), self.WORD.fullmatch
        fresh, marked, runs, words, joined, tails = set(), {}, set(), {}, [], self.tails
        if self.merges:
            # The commonest kinds need no pattern: plain words, and those with one mark behind.
            fresh = self.plain([key for key in missing if key.isalpha()])
            marked = [key for key in missing if key[-1] in tails and key[:-1].isalpha()]
            marked = dict(zip(marked, [key[:-1] for key in marked]))
            runs = self.plain(marked.values())
            if len(runs) < len(set(marked.values())):
                marked = {key: word for key, word in marked.items() if word in runs}
            missing = missing.difference(fresh, marked)
        for key in missing:
            m = self.merges and match(key)
            if m:
                line, word, tail, alone = m.groups()
                if line or alone:
                    word += "\n\n"
                runs.add(word)
                if line or tail:
                    if tail:
                        tail += "\n\n"
                        runs.add(tail)
                    joined.append((key, line, word, tail))
            elif not key.endswith("\n\n"):
                words[key] = key[1:] if key[0] == "\n" else " " + key
            elif key[:-2].isspace():
                pieces[key] = self.direct(key[:-2])
            else:
                words[key] = key[:-2]
        runs = {run for run in runs if run not in pieces} | fresh
        for before, keys in ((" ", [run for run in runs if run[-1] != "\n"]), ("", [run for run in runs if run[-1] == "\n"])):
            if keys:
                pieces.update(zip(keys, self.merges.encode(keys if before else [key[:-2] for key in keys], before)))
        keys, texts = list(words), list(words.values())
        for at in range(0, len(keys), GROUP):
            group = texts[at : at + GROUP]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["\n" + "\n".join(group)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.append(np.flatnonzero(ids == self.line_end), len(ids)).tolist()
            made = [ids[a + 1 : b].tobytes() for a, b in zip(cuts, cuts[1:])] if len(cuts) == len(group) + 1 else map(self.direct, group)
            for key, m in zip(keys[at : at + GROUP], made):
                pieces[key] = line_end + m if key[0] == "\n" else m
        pieces.update((key, pieces[word] + tails[key[-1]]) for key, word in marked.items())
        for key, line, word, tail in joined:
            pieces[key] = (line_end if line else b"") + pieces[word] + (pieces[tail] if tail else b"")


class WordEndEncoder(Encoder):
    """BPE with word ends: texts are lower-cased, white space is dropped.

    A text of Latin-1 characters (they compose and lower-case alike everywhere)
    falls apart into the units of the vocabulary's own word pattern; another one
    into runs of non-space, each encoded on its own.
    """

    #: The contractions and character classes of the vocabulary's word pattern, within Latin-1.
    UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")
    #: One unit, and nothing in it that lower-casing or composing may change.
    WHOLE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾\u0100-\U0010ffff]+")

    def split(self, text):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        return self.UNIT.findall(text.lower())

    def learn(self, missing):
        units = []
        for p in missing:
            if self.merges and len(p) <= 30 and self.WHOLE.fullmatch(p):
                units.append(p)
            else:
                self.pieces[p] = self.direct(p)
        if units:
            self.pieces.update(zip(units, self.merges.encode(units)))


@lru_cache(maxsize=4)
def load_encoder(path: str) -> Encoder:
    """The encoder for a ``tokenizers`` file; kinds other than these two are refused.

    A process keeps it, so the tasks of one Python worker share what was learned, until another function's tasks come.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    specials = [t["content"] for t in made["added_tokens"]]
    kind = WordEndEncoder if made["model"].get("end_of_word_suffix") == "</w>" else ByteLevelEncoder
    if kind is ByteLevelEncoder and (made["pre_tokenizer"]["type"] != "ByteLevel" or made["pre_tokenizer"].get("add_prefix_space") or made["normalizer"]):
        raise ValueError(f"{path}: not a supported kind of vocabulary")
    return kind(Tokenizer.from_file(path), specials, made["model"])


dropped_by(load_encoder.cache_clear)
