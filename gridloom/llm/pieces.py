"""A piece vocabulary as a double-array trie over UTF-8 bytes, walked for many strings at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Trie:
    """base and check of a double array; value is the piece that ends at a node, or -1. Node 0 is the root."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, i in words.items():
            node = 0
            for b in word:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = i
        size = 4 * len(children) + 70_000
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used, one, many = bytearray(size), 1, 1  # single children fill the gaps that the others leave
        place, queue = {0: 0}, [0]
        used[0] = 1
        for node in queue:  # breadth first; the list grows as it is read
            at, below = place[node], children[node]
            self.value[at] = ends[node]
            if not below:
                continue
            keys = sorted(below)
            if len(keys) == 1:
                slot = used.index(0, max(one, keys[0] + 1))
                one = used.index(0, one)
            else:
                slot, tries = used.index(0, max(many, keys[0] + 1)), 0
                while any(used[slot - keys[0] + k] for k in keys):
                    slot, tries = used.index(0, slot + 1), tries + 1
                if tries > 50:
                    many = slot
            base = slot - keys[0]
            self.base[at] = base
            for k in keys:
                used[base + k] = 1
                self.check[base + k] = at
                place[below[k]] = base + k
                queue.append(below[k])
        last = max(place.values()) + 258
        self.base, self.check, self.value = self.base[:last], self.check[:last], self.value[:last]

    def matches(self, text: np.ndarray, starts: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """text: strings of one length as rows of bytes. (i, j, rows, pieces) of all pieces that are text[rows, i:j], by i and then j."""
        n, length = text.shape
        for i in range(length):
            rows = np.arange(n) if starts is None else np.flatnonzero(starts[:, i])
            state = np.zeros(len(rows), np.int32)
            for j in range(i, length):
                to = self.base[state] + text[rows, j]
                ok = (self.check[to] == state) & (to > 0)
                if not ok.all():
                    rows, to = rows[ok], to[ok]
                if not len(rows):
                    break
                state = to
                found = self.value[state]
                if (hit := found >= 0).any():
                    yield i, j + 1, rows[hit], found[hit]


    def matches_along(self, text: np.ndarray, starts: np.ndarray, window: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """text: one long string. (i, j, pieces) of all pieces that are text[i:j], by i and then j, a window of places i at a time; all of its places are walked at once."""
        for low in range(0, len(text), window):
            at = low + np.flatnonzero(starts[low : low + window])
            state, depth, found = np.zeros(len(at), np.int32), 0, []
            while len(at):
                inside = at + depth < len(text)
                at, state = at[inside], state[inside]
                to = self.base[state] + text[at + depth]
                ok = (self.check[to] == state) & (to > 0)
                at, state, depth = at[ok], to[ok], depth + 1
                hit = self.value[state] >= 0
                found.append((at[hit], at[hit] + depth, self.value[state[hit]]))
            i, j, ids = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            order = np.lexsort((j, i))
            yield i[order], j[order], ids[order]


class Vocabulary:
    """Pieces, log scores and byte pieces of a public SentencePiece model; the file stays where it is."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.scores = np.array([model.get_score(i) for i in range(n)])
        normal = {model.id_to_piece(i).encode(): i for i in range(n) if not (model.is_byte(i) or model.is_unknown(i) or model.is_control(i) or model.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in map(bytes.decode, normal)):
            raise ValueError("a piece crosses a word's start")
        self.trie = Trie(normal)
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of = [b""] * n
        for piece, i in normal.items():
            self.bytes_of[i] = piece.decode().replace(MARK, " ").encode()
        self.is_byte = np.zeros(n, bool)
        for i in range(n):
            if model.is_byte(i):
                b = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[b], self.bytes_of[i], self.is_byte[i] = i, bytes([b]), True
        # Some models give a few pieces a sentinel of about -1e9, which is no log score to start from.
        own = self.scores[list(normal.values())]
        self.unknown = float(own[own > -1e8].min()) - 10.0


#: Words of more bytes are solved one by one along their length, shorter ones with all others of their length.
LONG = 96


def widths(text: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that starts at each place."""
    return np.select([text < 0x80, text < 0xE0, text < 0xF0], [1, 2, 3], 4)


def edges_along(word: bytes, v: Vocabulary, every_character: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, piece) of a long word's pieces, with -1 for characters: for all, or for those that are no piece themselves. Unknown ones come last of a place."""
    text = np.frombuffer(word, np.uint8)
    starts, width = (text & 0xC0) != 0x80, widths(text)
    low, window = 0, 1 << 17
    for i, j, ids in v.trie.matches_along(text, starts, window):
        c = low + np.flatnonzero(starts[low : low + window])
        if not every_character:
            alone = np.zeros(window, bool)
            alone[i[j - i == width[i]] - low] = True
            c = c[~alone[c - low]]
        i, j, ids = (np.concatenate(x) for x in ((i, c), (j, np.minimum(c + width[c], len(text))), (ids, np.full(len(c), -1))))
        order = np.argsort(i, kind="stable")
        yield i[order], j[order], ids[order]
        low += window


def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in words, matrix of bytes) for each length that occurs."""
    if not len(words):
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    flat = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
    kinds, first = np.unique(lengths[order], return_index=True)
    at = 0
    for k, (length, start) in enumerate(zip(kinds, first, strict=True)):
        stop = first[k + 1] if k + 1 < len(first) else len(order)
        yield order[start:stop], flat[at : at + length * (stop - start)].reshape(stop - start, length)
        at += length * (stop - start)
