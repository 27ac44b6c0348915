"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

1. A character trigram model is counted over all documents.
2. A lexicon is learned from labelled rows: words and word beginnings whose share of toxic documents can't be chance
   (binomial test over all candidates of equal support, near copies counted once).
3. Disguised tokens (digits, symbols and look-alikes for letters, letters spaced out or repeated, words torn in two) become lattices of what
   they may stand for. Viterbi search finds the likeliest reading under channel costs and character model, and, along a trie of the lexicon, the likeliest reading
   that spells an entry; the entry is taken if it is likelier by its prior. Both searches are exact, no readings are cut.
4. A document's score combines the toxic shares of the lexicon entries that its plain and restored words hit.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm import _text
from darkroom.runtime import ship

#: Labelled rows that the lexicon is learned from at most, chosen by hash of doc_id.
TRAINING_ROWS = 6_000
#: Bytes of their texts at most; rows beyond it aren't learned from.
TRAINING_BYTES = 128 << 20
CUT = 0.7
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A word beginning is also an entry by how many different words of a text have it.
LEVELS = (1, 2, 3, 5)
#: Letters of a window on a run or a long token; longer than any entry with its disguise, unless repetition is longer, which is cut to three first.
LONGEST = 64
REPEATED = re.compile(r"(.)\1{3,}", re.S)
CLASSES = 28  # a to z, other letters, outside words
OTHER, EDGE = 26, 27
#: Fixed table of letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t",
    "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¥": "y", "%": "x", "#": "h", "&": "a", "?": "i",
}
DROPPED = ".-_*~'^`,:;/\\=\"[]){}>"
#: Fixed table of letters of other scripts that look like Latin ones.
LOOKALIKE = dict(zip("аеорсухіѕјһԁԛԝԍοαεικνρτυχցսհ", "aeopcyxisjhdqwgoaeiknptuxguh"))
LOOKALIKE |= {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
LEET_COST, DROP_COST, REPEAT_COST, GAP_COST, SPACE_COST, WORD_PRIOR = 1.0, 0.7, 1.0, 3.0, 6.0, 8.0


def _upper_latin(buf: np.ndarray) -> np.ndarray:
    """Bytes in lower case: A-Z and the Latin-1 capitals."""
    low = _text.LOWER[buf]
    if len(buf) > 1:
        capital = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][capital] += 0x20
    return low


LETTER = np.zeros(256, dtype=bool)
LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
CLASS = np.full(256, EDGE, dtype=np.int64)
CLASS[97:123] = np.arange(26)
CLASS[128:] = OTHER
#: First bytes of Greek, Cyrillic, Armenian and full-width letters, which are disguise only beside a-z.
FOREIGN = np.zeros(256, dtype=bool)
FOREIGN[[0xCD, 0xCE, 0xCF, *range(0xD0, 0xD7), 0xEF]] = True
LEET_BYTE = np.zeros(256, dtype=bool)
LEET_BYTE[[ord(c) for c in LEET if ord(c) < 128]] = True


def leveled(h: np.ndarray, level: int) -> np.ndarray:
    """Entry hashes of beginnings that ``level`` different words have."""
    return h if level == 1 else _text.mix(h + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1)))


class Words:
    """Words of a slice by their cores: from the first to the last letter, in lower case."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = _upper_latin(buf)
        start, end, pointer = _text.word_spans(self.buf, offsets)
        self.start, self.end, self.rows = start, end, len(offsets) - 1
        self.row = _text.row_of(pointer)
        letter = LETTER[self.buf]
        before = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(letter, out=before[1:])
        at = np.flatnonzero(letter)
        has = before[end] > before[start]
        self.has = has
        first = np.where(has, at[np.minimum(before[start], len(at) - 1)] if len(at) else 0, start)
        last = np.where(has, at[np.maximum(before[end] - 1, 0)] + 1 if len(at) else 0, start)
        self.first, self.last = first, last
        plain = before[last] - before[first] == last - first
        # a run of three equal letters
        triple = np.zeros(len(buf) + 1, np.int64)
        if len(buf) > 2:
            run = letter[2:] & (self.buf[2:] == self.buf[1:-1]) & (self.buf[1:-1] == self.buf[:-2]) & (self.buf[2:] < 128)
            np.cumsum(run, out=triple[3:])
        tripled = triple[last] > triple[np.minimum(first + 2, len(buf))]
        # a single stand-in right before or after the core
        n = len(buf)
        near = np.zeros(len(start), dtype=bool)
        for side, inside, step in ((first - 1, first - 1 >= start, -1), (last, last < end, 1)):
            c = self.buf[np.clip(side, 0, n - 1)] if n else np.zeros(0, np.uint8)
            beyond = side + step
            # what stands beyond the word, or the text, is another character
            alone = (beyond < start) | (beyond >= end) | (c != self.buf[np.clip(beyond, 0, n - 1)]) if n else np.zeros(0, bool)
            near |= inside & LEET_BYTE[c] & alone & ~((c == 33) | (c == 63)) if step == 1 else inside & LEET_BYTE[c] & alone
        foreign, ascii_ = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        np.cumsum(FOREIGN[self.buf], out=foreign[1:])
        np.cumsum(CLASS[self.buf] < 26, out=ascii_[1:])
        mixed = (foreign[end] > foreign[start]) & (ascii_[end] > ascii_[start])
        self.odd = has & (~plain | tripled | near | mixed) & (end - start >= 4)
        self.rolling = _text.Rolling(self.buf)

    def kinds(self, keep: np.ndarray) -> list[np.ndarray]:
        """Hashes of the whole cores of some words, and of their beginnings (0 where a core isn't longer)."""
        a, b = self.first[keep], self.last[keep]
        return [self.rolling.of(a, b)] + [np.where(b - a > n, self.rolling.of(a, np.minimum(a + n, b)), np.uint64(0)) for n in PREFIXES]

    def long_enough(self) -> np.ndarray:
        """Words that may be entries."""
        return np.flatnonzero(self.has & (self.last - self.first >= 4))

    def entries(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct entries of some words: row, entry and the hash that it was made from; and each row's smallest word hash."""
        whole, *begin = self.kinds(keep)
        row = self.row[keep]
        low = np.full(self.rows, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, row, whole)
        rows, found, made = [], [], []
        for n, h in enumerate([whole, *begin]):
            some = h != 0
            r, p, w = row[some], h[some], whole[some]
            order = np.lexsort((w, p, r))
            r, p, w = r[order], p[order], w[order]
            pair = np.ones(len(r), dtype=bool)
            pair[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
            word = pair.copy()
            word[1:] |= w[1:] != w[:-1]
            count = np.add.reduceat(word.astype(np.int64), np.flatnonzero(pair)) if len(r) else np.zeros(0, np.int64)
            for level in LEVELS if n else LEVELS[:1]:
                rows.append(r[pair][count >= level])
                found.append(leveled(p[pair][count >= level], level))
                made.append(p[pair][count >= level])
        return np.concatenate(rows), np.concatenate(found), np.concatenate(made), low

    def disguised(self) -> Iterator[tuple[int, str, bool]]:
        """(row, text, cut) of odd tokens and of runs of three or more single characters.

        An odd token comes from its start and from every place in it where a word can begin, a run from every letter; what is longer than ``LONGEST`` is cut
        there, and so are overlapping windows.
        """
        for i in np.flatnonzero(self.odd).tolist():
            token = REPEATED.sub(r"\1\1\1", self.buf[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace"))
            for k in range(len(token) - 3 if len(token) > 4 else 1):
                if not k or token[k].isalnum() and not token[k - 1].isalnum():
                    yield int(self.row[i]), token[k : k + LONGEST], len(token) - k > LONGEST
        if not len(self.start):
            return
        single = (self.end - self.start == 1) & (self.has | LEET_BYTE[self.buf[self.start]])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while y - x >= 3:
                z = x + 1
                while z < y and self.row[z] == self.row[x]:
                    z += 1
                if z - x >= 3:
                    text = self.buf[self.start[x:z]].tobytes().decode("ascii", "replace")
                    for k in range(len(text) - 2):
                        yield int(self.row[x]), text[k : k + LONGEST], True
                x = z

    def torn(self, keys: np.ndarray) -> Iterator[tuple[int, str]]:
        """(row, text) of neighbouring plain words of which neither is an entry, but both together."""
        if not len(keys) or len(self.start) < 2:
            return
        a, b = self.first, self.last
        whole = self.has & (a == self.start) & (b == self.end)
        i = np.flatnonzero(whole[:-1] & whole[1:] & (self.row[1:] == self.row[:-1]) & (a[1:] == b[:-1] + 1) & (b[1:] - a[:-1] >= 5) & (b[1:] - a[:-1] <= LONGEST))
        if not len(i):
            return
        joined = self.rolling.joined(a[i], b[i], a[i + 1], b[i + 1])
        at = np.minimum(np.searchsorted(keys, joined), len(keys) - 1)
        for k in i[keys[at] == joined].tolist():
            yield int(self.row[k]), self.buf[a[k] : b[k + 1]].tobytes().decode("utf-8", "replace")


def entry_hash(word: str) -> int:
    """The hash of an entry, as ``Words.kinds`` has it."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_text.Rolling(data).of(np.array([0]), np.array([len(data)]))[0])


class Decoder:
    """Viterbi search over the character lattice of a token, freely and along the lexicon."""

    def __init__(self, counts: np.ndarray, entries: dict[str, float]):
        c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64) + 0.05
        three = c / c.sum(axis=2, keepdims=True)
        two = c.sum(axis=0)
        two /= two.sum(axis=1, keepdims=True)
        self.cost = (-np.log(0.8 * three + 0.2 * two[None])).tolist()
        self.entries = entries
        self.prefixes = {e[:k] for e in entries for k in range(len(e) + 1)}
        self.memo: dict[tuple[str, bool], tuple[str, float]] = {}

    @staticmethod
    def _class(ch: str) -> int:
        return ord(ch) - 97 if "a" <= ch <= "z" else EDGE if ch == " " else OTHER

    def options(self, ch: str, first: bool, last: bool) -> list[tuple[str, float]]:
        """What a character may stand for: (letter or nothing, cost)."""
        if ch == " ":
            return [("", SPACE_COST), (" ", 0.0)]
        if ch.isalpha():
            return [(ch, 0.0)] + ([(LOOKALIKE[ch], LEET_COST)] if ch in LOOKALIKE else [])
        out = [(x, LEET_COST) for x in LEET.get(ch, "")]
        if first or last:
            out.append(("", DROP_COST))
        elif ch in DROPPED or not out:
            out.append(("", DROP_COST))
        if ch == "*":
            out += [(x, GAP_COST) for x in "aeiou"]
        return out

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Options of every character."""
        return [self.options(ch, i == 0, i == len(token) - 1) for i, ch in enumerate(token)]

    def read(self, token: str) -> tuple[str, list[float]]:
        """The likeliest reading of a token, and the cost of the likeliest reading of each of its beginnings (by their length)."""
        states: dict[tuple, tuple[float, str]] = {(EDGE, EDGE, ""): (0.0, "")}
        best = [0.0]
        for choices in self.lattice(token):
            new: dict[tuple, tuple[float, str]] = {}
            for (p, q, last), (c, w) in states.items():
                for letter, cost in choices:
                    k = self._class(letter) if letter else q
                    moves = [((q, k, letter), c + cost + self.cost[p][q][k], w + letter)] if letter else [((p, q, last), c + cost, w)]
                    if letter and letter == last:  # a repeated letter may stand for one
                        moves.append(((p, q, last), c + cost + REPEAT_COST, w))
                    for state, total, word in moves:
                        if state not in new or (total, word) < new[state]:
                            new[state] = (total, word)
            states = new
            best.append(min(c for c, _ in states.values()))
        ends = [(c + self.cost[p][q][EDGE], w) for (p, q, _), (c, w) in states.items()]
        return min(ends)[1], best

    def spelled(self, token: str) -> Iterator[tuple[int, str, float]]:
        """(length of the beginning, entry, cost) of entries that beginnings of a token can stand for, at least cost."""
        held: dict[str, float] = {"": 0.0}
        for i, choices in enumerate(self.lattice(token), 1):
            new: dict[str, float] = {}
            for word, c in held.items():
                q = self._class(word[-1]) if word else EDGE
                p = self._class(word[-2]) if len(word) > 1 else EDGE
                for letter, cost in choices:
                    moves = [(word + letter, c + cost + self.cost[p][q][self._class(letter)])] if letter else [(word, c + cost)]
                    if letter and word[-1:] == letter:
                        moves.append((word, c + cost + REPEAT_COST))
                    for longer, total in moves:
                        if longer in self.prefixes and total < new.get(longer, math.inf):
                            new[longer] = total
            held = new
            if not held:
                return
            yield from ((i, word, c) for word, c in held.items() if word in self.entries)

    def restore(self, token: str, cut: bool = False) -> tuple[str, float]:
        """The likeliest word behind a token, with the lexicon's prior, and the toxic share of its entry (0 if none).

        An entry must be the whole word or, with 4 to 9 letters, its beginning; of a ``cut`` window, which may go on after a word, any beginning.
        """
        if (token, cut) in self.memo:
            return self.memo[token, cut]
        word, best = self.read(token)
        share, gain = 0.0, 0.0
        for i, entry, cost in self.spelled(token):
            if len(entry) < 4 or not (cut or i == len(token) or len(entry) in PREFIXES):
                continue
            if best[i] + WORD_PRIOR - cost > 0 and (self.entries[entry], i) > (share, gain):
                share, gain = self.entries[entry], i
                if i == len(token):
                    word = entry
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[token, cut] = word, share
        return word, share


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CLASSES**3, np.int64)
    for _, buf, offsets in _text.slices(batches):
        low = _upper_latin(buf)
        edge = np.zeros(len(low) + 1, dtype=bool)
        edge[offsets] = True
        lead = (low & 0xC0) != 0x80
        c = CLASS[low]
        c = c[lead]
        # rows are kept apart by edges
        at = np.flatnonzero(edge[:-1][lead])
        c = np.insert(c, at, EDGE)
        if len(c) > 2:
            total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    some = np.flatnonzero(total)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all texts; a table of fixed size."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_trigrams, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES**3, np.int64)
    for r in rows:
        out[r["code"]] = r["n"]
    return out


def learn_lexicon(texts: list[str | None], toxic: list[int]) -> tuple[dict[int, float], set[int], float, dict[str, float]]:
    """From labelled texts: toxic share by entry, hashes that entries are made from, the toxic share of texts without any entry, and entries in letters."""
    pairs: dict[bytes, tuple[str, int]] = {(t or "").encode(): (t or "", y) for t, y in zip(texts, toxic)}
    texts, toxic = [t for t, _ in pairs.values()], [y for _, y in pairs.values()]
    if not texts:
        return {}, set(), 0.0, {}
    y = np.array(toxic, dtype=bool)

    made_from: set[int] = set()

    def gathered(which: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (entry, group) pairs of some texts, and all groups; near copies mostly share a group, their smallest word hash."""
        column = _text.text_array(pa.array([texts[i] for i in which], pa.large_string()))
        pairs, groups = [], []
        for _, buf, offsets in _text.slices([pa.RecordBatch.from_arrays([column], ["text"])]):
            words = Words(buf, offsets)
            rows, found, made, low = words.entries(words.long_enough())
            if wanted is not None:
                at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                rows, found, made = rows[wanted[at] == found], found[wanted[at] == found], made[wanted[at] == found]
                made_from.update(made.tolist())
            pairs.append(np.stack([found, low[rows]]))
            groups.append(low)
        both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.uint64)
        return both[0], both[1], np.unique(np.concatenate(groups)) if groups else np.zeros(0, np.uint64)

    found, _, yes = gathered(np.flatnonzero(y), None)
    names, a = np.unique(found, return_counts=True)
    names, a = names[a >= 3], a[a >= 3].astype(float)
    other, _, no = gathered(np.flatnonzero(~y), names if len(names) else np.zeros(1, np.uint64))
    b = np.zeros(len(names))
    if len(names):
        np.add.at(b, np.searchsorted(names, other), 1.0)
    n = a + b
    base = len(yes) / max(1, len(yes) + len(no))
    if not 0 < base < 1 or not len(names):
        return {}, set(), float(base), {}
    made_from.clear()
    at_least = np.cumsum(np.bincount(n.astype(int))[::-1])[::-1]
    chance = np.array([math.lgamma(p + 1) - math.lgamma(q + 1) - math.lgamma(p - q + 1) for p, q in zip(n, a)])
    chance += a * math.log(base) + b * math.log1p(-base)
    # entries of equal support that only one label can have seen are counted in as well
    share = (a + 2 * base) / (n + 2)
    good = (chance + np.log(at_least[n.astype(int)] / base**2) < math.log(0.01)) & (share >= 0.75) & (a >= 0.9 * n)
    lexicon = dict(zip(names[good].tolist(), share[good].tolist()))
    keys = np.array(sorted(lexicon), dtype=np.uint64)
    clean = np.zeros(2)
    for label, which in ((1, np.flatnonzero(y)), (0, np.flatnonzero(~y))):
        hit, group, all_groups = gathered(which, keys if len(keys) else np.zeros(1, np.uint64))
        clean[label] = len(all_groups) - len(np.unique(group))
    return lexicon, made_from, float((clean[1] + base) / (clean.sum() + 1)), _letters([texts[i] for i in np.flatnonzero(y)], lexicon)


def _letters(texts: list[str], lexicon: dict[int, float]) -> dict[str, float]:
    """Entries that a single word makes, in letters, from the texts that they were learned from."""
    out: dict[str, float] = {}
    column = _text.text_array(pa.array(texts, pa.large_string()))
    for _, buf, offsets in _text.slices([pa.RecordBatch.from_arrays([column], ["text"])]):
        words = Words(buf, offsets)
        keep = words.long_enough()
        for n, h in zip((0, *PREFIXES), words.kinds(keep)):
            values, at = np.unique(h, return_index=True)
            for value, i in zip(values.tolist(), keep[at].tolist()):
                if value in lexicon:
                    a, b = words.first[i], words.last[i]
                    data = words.buf[a : min(a + n, b) if n else b].tobytes()
                    out[data.decode("utf-8", "ignore")] = lexicon[value]
    return out


class Scorer:
    """Scores slices of texts under a lexicon and a character model."""

    def __init__(self, counts: np.ndarray, lexicon: dict[int, float], made_from: set[int], rest: float, entries: dict[str, float]):
        self.decoder, self.rest = Decoder(counts, entries), min(rest, 0.5)
        self.single = np.array(sorted(entry_hash(e) for e in entries), dtype=np.uint64)
        self.keys = np.array(sorted(lexicon), dtype=np.uint64)
        self.share = np.array([lexicon[k] for k in self.keys.tolist()])
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(np.array(sorted(made_from), dtype=np.uint64) & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1: what the best entry says, raised a little by every further one."""
        rows = len(offsets) - 1
        words = Words(buf, offsets)
        best, more = np.zeros(rows), np.zeros(rows)
        if len(self.keys) and len(words.start):
            keep = words.long_enough()
            maybe = np.zeros(len(keep), dtype=bool)
            for h in words.kinds(keep):
                maybe |= self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            row, found, _, _ = words.entries(keep[maybe])
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            true = self.keys[at] == found
            np.maximum.at(best, row[true], self.share[at[true]])
            np.add.at(more, row[true], 1.0)
            for i, text, cut in [*words.disguised(), *((i, text, False) for i, text in words.torn(self.single))]:
                share = self.decoder.restore(text, cut)[1]
                if share:
                    best[i] = max(best[i], share)
                    more[i] += 1
        return np.where(more > 0, 1 - (1 - best) * 0.95 ** np.maximum(more - 1, 0), self.rest)

    def restored(self, text: str) -> str:
        """The text with disguised tokens replaced by the words that they stand for, in lower case where replaced."""
        out = []
        for token in text.split(" "):
            data = token.encode()
            words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            out.append(self.decoder.restore(token.lower())[0] if len(words.odd) == 1 and words.odd[0] else token)
        return " ".join(out)


_scorers: dict = {}


def _score(key: str, model: tuple, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(*model)
        scorer = _scorers[key]
        for batch, buf, offsets in _text.slices(batches):
            own = [batch.column(0), pa.array(scorer.score(buf, offsets))]
            if with_text:
                own.append(pa.array([None if t is None else scorer.restored(t) for t in batch.column(1).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays(own, ["doc_id", "score", "restored"][: len(own)])

    return run


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that nothing is learned from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", with_text: bool = False) -> DataFrame:
    """Toxicity of every row: doc_id, score (and, if asked for, restored: the text with disguised words restored).

    Learned from at most ``TRAINING_ROWS`` labelled rows (and ``TRAINING_BYTES``) that aren't held out (of repeated labels the largest counts; null labels none); the
    character model is counted over all rows. Scores depend on texts alone. Null and empty texts get the score of texts without any lexicon
    entry. Rows with null or repeated doc_id are scored like others; an empty table gives an empty table; without usable labels all scores are equal.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(F.max(F.col(toxic)).cast("int").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    known = F.broadcast(known)  # at most TRAINING_ROWS rows
    sizes = rows.join(known, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    took, n, size = [], 0, 0
    for r in sizes:
        n, size = n + r["n"], size + (r["bytes"] or 0)
        if n <= TRAINING_ROWS and size <= TRAINING_BYTES:
            took.append(r["doc_id"])
    sample = rows.join(known, "doc_id").where(F.col("doc_id").isin(took)) if len(took) < len(sizes) else rows.join(known, "doc_id")
    sample = sample.select("doc_id", "text", "y").toArrow()  # bounded by TRAINING_ROWS and TRAINING_BYTES
    order = np.argsort(sample.column("doc_id").to_numpy(), kind="stable")
    sample = sample.take(pa.array(order))
    lexicon, made_from, rest, entries = learn_lexicon(sample.column("text").to_pylist(), sample.column("y").to_pylist())
    counts = character_counts(rows)
    key = f"{zlib.crc32(counts.tobytes())}-{len(lexicon)}-{sum(lexicon)}-{rest}"
    schema = "doc_id bigint, score double" + (", restored string" if with_text else "")
    return rows.mapInArrow(_score(key, (counts, lexicon, made_from, rest, entries), with_text), schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``: doc_id, held_out, score, predicted."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
