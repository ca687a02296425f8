"""Encoding and decoding with a SentencePiece BPE model through a table of each prefix's last token.

The encoding of a text by merges has one property that makes it linear: if a token ends at some place of a text, then
the tokens up to there are the encoding of that prefix. So each prefix has one last token, and it suffices to store that
one: of the pieces that an automaton finds to end at a place, the right one is the one that goes with the last token of
the prefix before it, that is, whose pair is left alone by the merges when both stand side by side. Ids are then read
backwards from the end. Pairs are judged by running the merges on the two pieces alone, which is enough: until a merge
first crosses their border, each side merges as it would by itself.

Texts are cut first where no piece can lie across, by the finest of a few patterns that leaves every piece of the model
whole (with most models: words with the spaces before them, and what stands between words). Such parts are remembered
while a bounded cache has room, so a frequent word meets the table once in a worker.

Characters outside the vocabulary become the byte pieces of their UTF-8 form, as in the library. Null texts are empty;
an empty text has the begin and end ids alone and decodes to "". Rows stay as they are: repeated rows come out alike, a
null doc_id stays null, no documents give no rows, and columns that are not named play no part.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, whole_text, with_columns

SPACE = "▁"
#: Entries that a Python worker keeps of the parts of texts; later ones are worked out each time.
CACHE_PARTS = 300_000
#: Slots for judged pairs (a prime number); a pair takes the place of another one that falls in its slot.
PAIR_SLOTS = 1_999_993
#: Longer parts are not kept (they hardly come again).
CACHED_CHARS = 48
_OUTSIDE = -1


class Pieces:
    """The pieces of the model file at ``path``, which must be BPE with byte pieces and no rewriting of texts but marks in
    place of spaces and one before the text; decodes ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("  ÅＡ b ") != f"{SPACE * 3}ÅＡ{SPACE}b{SPACE}":
            raise ValueError("the model rewrites texts before it encodes them")
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.is_byte = np.array([model.is_byte(i) for i in range(len(self.pieces))])
        if self.is_byte.sum() != 256:
            raise ValueError("the model has no byte pieces")
        self.silent = np.array([model.is_control(i) for i in range(len(self.pieces))])
        self.spaced = np.array([p.startswith(SPACE) for p in self.pieces])
        plain = [not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) for i in range(len(self.pieces))]
        self.score = {p: model.get_score(i) for i, p in enumerate(self.pieces) if plain[i]}

        # What each id adds to a decoded text, end to end in one buffer.
        said = [self._says(i, model) for i in range(len(self.pieces))]
        self.said_length = np.array([len(s) for s in said])
        self.said_start = np.r_[0, np.cumsum(self.said_length)[:-1]]
        self.said = np.frombuffer(b"".join(said), np.uint8)

    def _says(self, i: int, model) -> bytes:
        if self.is_byte[i]:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if model.is_unknown(i):
            return model.decode([i]).encode()
        return b"" if self.silent[i] else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, raw: bytes) -> str:
        """The text of ids (little-endian, 32 bits). A byte that is part of no character becomes U+FFFD."""
        ids = np.frombuffer(raw, "<u4").astype(np.int64)
        heard = np.flatnonzero(~self.silent[ids])
        if not len(heard):
            return ""
        ids = ids[heard[0] : heard[-1] + 1]
        skip = int(self.spaced[ids[0]])  # the mark before the text is no part of it
        if len(heard) == len(ids):
            try:
                return self._said_by(ids)[skip:].tobytes().decode()
            except UnicodeDecodeError:
                pass
        return self._by_runs(ids)[skip:]

    def _said_by(self, ids: np.ndarray) -> np.ndarray:
        length = self.said_length[ids]
        to = np.cumsum(length)
        return self.said[np.repeat(self.said_start[ids] - to + length, length) + np.arange(to[-1])]

    def _by_runs(self, ids: np.ndarray) -> str:
        """As the library decodes: bytes make characters with the bytes beside them only, not across other ids."""
        kind = np.where(self.silent[ids], 2, self.is_byte[ids])
        out = []
        for run in np.split(ids, np.flatnonzero(np.diff(kind)) + 1):
            data = self._said_by(run).tobytes()
            while data:
                try:
                    out.append(data.decode())
                    break
                except UnicodeDecodeError as e:  # one mark for each byte
                    out.append(data[: e.start].decode() + "\ufffd")
                    data = data[e.start + 1 :]
        return "".join(out)


class PrefixTable(Pieces):
    """Encodes as well: the table of last tokens, with what it needs to judge pairs."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__(path)
        self.ids = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.length = [len(p) for p in self.pieces]
        self.byte_id = {int(self.pieces[i][1:-1], 16): int(i) for i in np.flatnonzero(self.is_byte)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        if {c for p in self.ids for c in p} - set(self.ids):
            raise ValueError("a piece holds a character that is no piece")
        self.part = self._cuts()
        self.known: dict[str, bytes] = {}
        self.pairs = array("q", [-1 << 62]) * PAIR_SLOTS  # twice the pair's number, and one more if it goes together
        self._trace_merges()

    def _cuts(self) -> re.Pattern:
        """How texts are cut: into words, runs of other characters and line ends if no piece is cut by that, else before
        spaces, else not at all. Numbers that are no decimal digits count as no letters."""
        numbers = re.escape("".join(sorted({c for p in self.ids for c in p if c.isnumeric() and not c.isalpha()})))
        words = rf"{SPACE}*[^\W\d_{numbers}]+|{SPACE}*(?:[^\w{SPACE}\n]|[\d_{numbers}])+|{SPACE}+|\n"
        ways = map(re.compile, (words, rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", r"(?s:.+)"))
        return next(way for way in ways if all(way.match(p).end() == len(p) for p in self.ids))

    def merged(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The pieces of a short text and the merges that made them: the best pair first, the first of equal ones."""
        parts, score, steps = list(text), self.score, []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = score.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or got > best):
                    best, at = got, i
            if at < 0:
                break
            steps.append((-best, parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, steps

    def _trace_merges(self) -> None:
        """Of each piece how late it is merged and from which two. Where every piece comes about by merges of growing
        rank, the order of all merges of a pair of pieces is known from their ranks; other pieces are marked odd."""
        self.rank = {p: -s for p, s in self.score.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        self.odd: set[str] = set()
        for piece in self.ids:
            parts, steps = self.merged(piece)
            ranks = [s[0] for s in steps]
            if parts != [piece] or ranks != sorted(ranks) or not piece.strip(SPACE):  # marks of spaces all have one rank
                self.odd.add(piece)
            elif steps:
                self.halves[piece] = steps[-1][1:]

    def _left_alone(self, a: str, b: str) -> bool:
        """Whether merges never cross the border of ``a`` and ``b``. The merges of both are undone from the last one on;
        at each state of the border, a pair across it would have been merged if its rank came before what was undone."""
        if a in self.odd or b in self.odd:
            return self.merged(a + b)[0] == [a, b]
        rank, halves = self.rank, self.halves
        limit = float("inf")
        tie = False  # whether a pair across the border wins against an equal rank, being further left
        while True:
            across = rank.get(a + b)
            if across is not None and (across < limit or tie and across == limit):
                return False
            in_a, in_b = halves.get(a), halves.get(b)
            if in_a is None and in_b is None:
                return True
            if in_b is None or in_a is not None and rank[a] > rank[b]:
                limit, tie, a = rank[a], False, in_a[1]
            else:
                limit, tie, b = rank[b], True, in_b[0]

    def _judged(self, before: int, token: int) -> int:
        """What to keep of a pair: whether ``token`` is left alone by the merges behind ``before`` (or at the beginning)."""
        piece = self.pieces[token]
        fits = self.merged(piece)[0] == [piece] if before == _OUTSIDE else self._left_alone(self.pieces[before], piece)
        key = before * len(self.pieces) + token
        held = self.pairs[key % PAIR_SLOTS] = 2 * key + fits
        return held

    def _encoded(self, part: str) -> bytes:
        n, length, pairs, size = len(part), self.length, self.pairs, len(self.pieces)
        last, done = [_OUTSIDE], 0  # of the prefix of each length so far
        for end, token in self.automaton.iter(part):  # at each place the longest piece first
            if end < done:
                continue  # the token that ends here is known
            if end > len(last) - 1:  # characters that no piece ends at are outside the vocabulary
                last += [_OUTSIDE] * (end - len(last) + 1)
            before = last[end + 1 - length[token]]
            key = before * size + token
            held = pairs[key % PAIR_SLOTS]
            if held >> 1 != key:
                held = self._judged(before, token)
            if held & 1:
                last.append(token)
                done = end + 1
        last += [_OUTSIDE] * (n + 1 - len(last))
        ids, at = array("I"), n
        while at:
            token = last[at]
            if token == _OUTSIDE:
                ids.extend(self.byte_id[b] for b in reversed(part[at - 1].encode()))
                at -= 1
            else:
                ids.append(token)
                at -= length[token]
        ids.reverse()
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids of a whole text, without begin and end."""
        if not text:
            return b""
        known, found = self.known, []
        for part in self.part.findall(SPACE + text.replace(" ", SPACE)):
            got = known.get(part)
            if got is None:
                got = self._encoded(part)
                if len(known) < CACHE_PARTS and len(part) <= CACHED_CHARS:
                    known[part] = got
            found.append(got)
        return b"".join(found)


_LOADED: dict[tuple[type, str], Pieces] = {}


def _loaded(kind: type, path: str):
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def encode_documents(documents: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None), ``ids`` (binary: little-endian 32-bit ids, with begin and end) and
    ``n_tokens``. ``path`` is the model's, the same on every machine."""

    def work(texts):
        model = _loaded(PrefixTable, path)
        begin, end = array("I", [model.bos]).tobytes(), array("I", [model.eos]).tobytes()
        ids = [begin + model.encode(t) + end for t in texts]
        return ids, [len(x) // 4 for x in ids]

    return with_columns(documents, [whole_text(text)], "ids binary, n_tokens long", work, keep)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``decoded``, the text of the binary column ``ids``; null where that is null."""

    def work(raws):
        model = _loaded(Pieces, path)
        return ([None if raw is None else model.decode(raw) for raw in raws],)

    return with_columns(encoded, [F.col(ids)], "decoded string", work, keep)


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_documents(table(spark, sf_dir, "documents"), path, keep=["doc_id"])
    return decode_ids(encoded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
