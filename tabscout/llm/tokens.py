"""Token ids of whole texts by a ready-made tokenizer, with a memory of repeated pieces.

A text is cut only where the tokenizer itself must cut, each distinct piece is encoded by the
``tokenizers`` library once and remembered, so the result is that of encoding the text whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .words import mixed, segment_sums

# Letters that are certain to be letters for every Unicode version, and the
# ASCII characters that are none.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHERS = r"\x00-@\[-`{-\x7f"
_MARKS = "".join(map(chr, [*range(33, 65), *range(91, 97), *range(123, 127)]))
_BEYOND = "\u0250"
_LENGTH = np.uint64(0x9E6C63D0876A9A47)
_WORD_THEN_REST = re.compile(rf"( ?[{_LETTERS}]+)([{_OTHERS}].*)", re.S)
_MARKS_THEN_LINE = re.compile(rf"([!-@\[-`{{-~]*\n)([{_LETTERS}].*)", re.S)


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, with ``end_id`` after each text.

    ``drops_space`` says that the vocabulary ignores white space; otherwise a single space
    belongs to the piece after it. Text with other runs of white space around a space is
    encoded whole. At most about ``most`` pieces are remembered, by 64-bit hashes in arrays
    (some 40 bytes each); later ones are forgotten after their batch.
    """

    def __init__(self, path: str, end_id: int, drops_space: bool, most: int = 800_000,
                 most_parts: int = 160_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end = array("I", [end_id]).tobytes()
        self.drops_space, self.most, self.most_parts = drops_space, most, most_parts
        mark = (lambda t: t.endswith("</w>")) if drops_space else (lambda t: t.startswith("Ġ"))
        vocabulary = self.tokenizer.get_vocab()
        self.edges = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edges[[i for token, i in vocabulary.items() if mark(token)]] = True
        self.parts: dict[str, bytes] = {}
        # Known pieces: ascending hashes, and for each where its ids are and how many; an
        # entry without a place stands for a piece that its text cannot be cut at.
        self.hashes = np.zeros(0, np.uint64)
        self.places, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.frombuffer(self.end, np.uint32)

    def _batch(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, encoded side by side and told apart by the tokens.

        Where the vocabulary drops white space, a word's last token has the word-end mark;
        otherwise its first token has the space, and every word here begins with one.
        """
        out = []
        for i in range(0, len(words), 2048):
            some = words[i:i + 2048]
            text = (" " if self.drops_space else "").join(some)
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.edges[ids])
            cuts = cuts + 1 if self.drops_space else np.append(cuts[1:], len(ids))
            if len(cuts) != len(some):
                out += self._batch(some)
                continue
            data, low = ids.tobytes(), 0
            for high in (4 * cuts).tolist():
                out.append(data[low:high])
                low = high
        return out

    def _cut(self, piece: str) -> list[str]:
        out = []
        while piece:
            m = _WORD_THEN_REST.fullmatch(piece) or _MARKS_THEN_LINE.fullmatch(piece)
            if m is None:
                out.append(piece)
                break
            out.append(m[1])
            piece = m[2]
        return out

    def _learn(self, words: list[str], prefix: str) -> list[bytes | None]:
        """Ids of pieces that follow ``prefix``; none where a text must not be cut."""
        known, plain, cuts, out = self.parts, [], {}, {}
        fresh: set[str] = set()
        for word in words:
            core = word.rstrip(_MARKS)
            # Letters and then marks, by far the most usual piece.
            if core.isalpha() and core[-1] < _BEYOND:
                plain.append((word, prefix + core, word[len(core):]))
            elif not self.drops_space and (
                    not word or word[-1].isspace() or prefix and word[0].isspace()):
                out[word] = None
            else:
                cuts[word] = self._cut(prefix + word)
                fresh.update(cuts[word])
        fresh.update({tail for _, _, tail in plain})
        cores = {core for _, core, _ in plain} - fresh
        new = [part for part in fresh if part not in known]
        known.update(zip(new, self._batch(new), strict=True))
        cores = [core for core in cores if core not in known]
        side_by_side = prefix or self.drops_space
        known.update(zip(
            cores, (self._words if side_by_side else self._batch)(cores), strict=True))
        out.update([(word, known[core] + known[tail]) for word, core, tail in plain])
        for word, parts in cuts.items():
            out[word] = b"".join([known[p] for p in parts])
        if len(known) > self.most_parts:
            known.clear()
        return [out[word] for word in words]

    def _look_up(self, data: bytes, starts, ends, first) -> tuple[np.ndarray, np.ndarray]:
        """(place, count) of the ids of each piece, after learning the new ones."""
        hashes = mixed(segment_sums(np.frombuffer(data, np.uint8), starts, ends)
                       + (2 * (ends - starts) + first).astype(np.uint64) * _LENGTH)
        some, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, some)
        at[at == len(self.hashes)] = 0
        new = np.flatnonzero(self.hashes[at] != some) if len(self.hashes) else np.arange(len(some))
        if len(new):
            cuts = where[new].tolist()
            words = [data[a:b].decode() for a, b in zip(
                starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            learnt: list[bytes | None] = [None] * len(words)
            for leads in (True, False):
                chosen = [i for i, c in enumerate(cuts) if bool(first[c]) == leads]
                prefix = "" if leads or self.drops_space else " "
                for i, ids in zip(chosen, self._learn([words[i] for i in chosen], prefix), strict=True):
                    learnt[i] = ids
            counts = np.array([len(x or b"") // 4 for x in learnt], np.int64)
            places = len(self.ids) + np.cumsum(counts) - counts
            places[[i for i, x in enumerate(learnt) if x is None]] = -1
            self.ids = np.concatenate((self.ids, np.frombuffer(
                b"".join([x for x in learnt if x]), np.uint32)))
            spot = np.searchsorted(self.hashes, some[new])
            self.hashes = np.insert(self.hashes, spot, some[new])
            self.places = np.insert(self.places, spot, places)
            self.counts = np.insert(self.counts, spot, counts)
            at = np.searchsorted(self.hashes, some)
        at = at[which]
        return self.places[at], self.counts[at]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        raw = [t.encode() for t in texts]
        data = b" ".join(raw)
        space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        starts, ends = np.append(0, space + 1), np.append(space, len(data))
        begins = np.cumsum([0, *[len(r) + 1 for r in raw[:-1]]])
        lead = np.searchsorted(starts, begins)
        first = np.zeros(len(starts), bool)
        if not self.drops_space:
            first[lead] = True
        held = self.hashes, self.places, self.counts, self.ids
        places, counts = self._look_up(data, starts, ends, first)
        whole = np.logical_or.reduceat(places < 0, lead)
        # The end id stands at place 0 and follows the last piece of each text.
        stops = np.append(lead[1:], len(starts))
        places, counts = np.insert(places, stops, 0), np.insert(counts, stops, 1)
        total = np.cumsum(counts)
        source = np.repeat(places - (total - counts), counts) + np.arange(total[-1])
        flat = self.ids[source].astype("<u4").tobytes()
        marks = (4 * total[stops + np.arange(len(stops))]).tolist()
        out = [flat[a:b] for a, b in zip([0, *marks[:-1]], marks, strict=True)]
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._batch([texts[i]])[0] + self.end
        if len(self.hashes) > self.most:
            self.hashes, self.places, self.counts, self.ids = held
        return out


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, end_id: int, drops_space: bool, most: int = 800_000) -> PieceEncoder:
    """One per worker process, kept between tasks."""
    key = (path, end_id, drops_space, most)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]
