"""BPE encoding by a trie of distinct words whose paths carry the last token of every prefix.

If t1 ... tn encodes a word, t1 ... ti encodes the prefix that ends with ti, so a prefix's encoding is known by its last
token alone; and a token may follow another if merging both together would leave the border between them.
Words are walked in sorted order, which is the depth-first order of their trie: the stack holds, for each letter of
the path, the prefix's last token, and a word that shares a prefix with the one before finds those states ready.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartolina.llm.words import chunks, kept, trim

_FOREVER = 1 << 60

#: Letters and numbers up to U+024F, by their Unicode categories; beyond it the library's own splitter works.
_PLAIN_END = "ɏ"
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sa-zA-ZªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+")
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte: itself if it is a visible character of Latin-1, else the next one from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """A vocabulary with its merges, and the walk over a trie of words."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str):
        self.end = end
        self.names = {i: t for t, i in vocab.items()}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(end)}
        self.final = {t[: -len(end)]: i for t, i in vocab.items() if t.endswith(end)}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            if a in vocab and b in vocab and a + b in vocab:
                self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self._splits: dict[int, tuple[int, int, int] | None] = {}
        self._meets: dict[int, bool] = {}
        self._spines: dict[tuple[int, int], list] = {}
        self.inner, self.final = ({t: i for t, i in kind.items() if (self.split(i) or (0,))[0] >= 0} for kind in (self.inner, self.final))
        self.lengths = self._lengths(self.inner), self._lengths(self.final)

    @staticmethod
    def _lengths(kind: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """By their last three letters (or two, or one, where no longer token has these), how long the tokens are, longest first."""
        found: dict[str, set[int]] = {}
        for t in kind:
            for n in (1, 2, 3):
                if len(t) >= n:
                    found.setdefault(t[-n:], {1}).add(min(len(t), len(t) if n == 3 else n))
        for end in [e for e in found if len(e) == 3]:
            found[end] |= found.get(end[1:], {1})
        return {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}

    def plain(self, parts: list[int]) -> list[tuple[int, int, int, int]]:
        """The merges that BPE makes of these symbols, in order: (rank, left, right, merged). Only for single tokens."""
        done, parts = [], list(parts)
        while True:
            best = min(((*self.rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank), key=lambda m: (m[0], m[2]), default=None)
            if best is None:
                return done if len(parts) == 1 else []
            r, merged, i = best
            done.append((r, parts[i], parts[i + 1], merged))
            parts[i : i + 2] = [merged]

    def split(self, token: int) -> tuple[int, int, int] | None:
        """The merge that makes the token: rank, left, right; None for a single symbol, rank -1 if merging never makes it."""
        if token not in self._splits:
            name = self.names[token]
            ended = name.endswith(self.end) and name != self.end
            letters = name[: -len(self.end)] if ended else name
            symbols = [self.inner.get(c, -1) for c in letters]
            if ended:
                symbols[-1] = self.final.get(letters[-1], -1)
            made = self.plain(symbols) if len(symbols) > 1 else []
            self._splits[token] = None if len(symbols) == 1 else made[-1][:3] if made and made[-1][3] == token else (-1, -1, -1)
        return self._splits[token]

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens along one edge as merging goes back in time, each with the ranks of the merges that end and make it."""
        key = (token, side)
        if key not in self._spines:
            out, ends = [], _FOREVER
            while True:
                made = self.split(token)
                out.append((token, ends, -1 if made is None else made[0]))
                if made is None:
                    break
                ends, token = made[0], made[side]
            self._spines[key] = out
        return self._spines[key]

    def meets(self, left: int, right: int) -> bool:
        """Whether the border between the two tokens stays when their letters are merged together."""
        if len(self._meets) > 400_000:
            self._meets.clear()
        known = self._meets[left << 32 | right] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        for a, a_ends, a_born in self._spine(left, 2):
            for b, b_ends, b_born in self._spine(right, 1):
                merge = self.rank.get((a, b))
                # Of equal merges the leftmost is made first: one within the left token precedes one across the border.
                if merge and max(a_born, b_born) < merge[0] < a_ends and merge[0] <= b_ends:
                    return False
        return True

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Each distinct word's ids; words are spelled in the vocabulary's own letters."""
        out: dict[str, list[int]] = {}
        inner, final, known, meets = self.inner, self.final, self._meets, self.meets
        inner_lengths, final_lengths = self.lengths
        last, start = [-1], [-1]  # of the path's prefix of each length: its last token, and where that starts
        path = ""
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(n - 1, len(last) - 1)
            while shared < most and word[shared] == path[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :]
            path = word
            for i in range(shared + 1, n + 1):
                kind, lengths = (inner, inner_lengths) if i < n else (final, final_lengths)
                near = lengths.get(word[i - 3 : i]) if i > 2 else None
                for k in near or lengths.get(word[i - 2 : i] if i > 1 else word[:1], (1,)):
                    j = i - k
                    if j < 0:
                        continue
                    t = kind.get(word[j:i])
                    if t is not None:
                        if j == 0:
                            break
                        stays = known.get(last[j] << 32 | t)
                        if meets(last[j], t) if stays is None else stays:
                            break
                else:
                    raise ValueError(f"no token for {word[i - 1]!r}")
                last.append(t)
                start.append(j)
            ids = [last[n]]
            j = start[n]
            while j:
                ids.append(last[j])
                j = start[j]
            del last[n], start[n]  # the end of a word is not a prefix of another
            out[word] = ids[::-1]
        return out


class Codec:
    """Encodes and decodes whole texts as the library does with the same file."""

    LONGEST = 64

    def __init__(self, data: bytes, limit: int = 100_000):
        told = json.loads(data)
        model = told["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = Merges(model["vocab"], pairs, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = self.merges.names | {i: t for t, i in self.special.items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        library = Tokenizer.from_str(data.decode())
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.bytes = _byte_letters()
        self.limit = limit
        self.known: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.old_words: dict[str, tuple[bytes, str]] = {}

    def _words(self, token: str) -> list[str]:
        """A token without white space, cut and spelled in byte letters."""
        if token.isascii() and token.isprintable():
            return _PLAIN.findall(token.lower())
        if max(token) <= _PLAIN_END and not _ODD_SPACE.search(token):
            return ["".join(map(self.bytes.__getitem__, w.encode())) for w in _PLAIN.findall(token.lower())]
        return [w for w, _ in self.pre_tokenize(self.normalize(token))]

    def _learn(self, tokens: set[str]) -> None:
        cut = {t: self._words(t) for t in tokens}
        if len(self.words) > self.limit:
            self.old_words, self.words = self.words, {}
        ids, old, names = self.words, self.old_words, self.names
        plain = {w for words in cut.values() for w in words}.difference(ids)
        for w in [w for w in plain if w in old]:
            ids[w] = old[w]
            plain.discard(w)
        for w, coded in self.merges.encode(plain).items():
            ids[w] = (_PACKED[len(coded)](*coded) if len(coded) < 16 else struct.pack(f"<{len(coded)}I", *coded), " ".join([names[i] for i in coded]))
        for t, words in cut.items():
            self.known[t] = ids[words[0]] if len(words) == 1 else (b"".join([ids[w][0] for w in words]), " ".join([ids[w][1] for w in words]))

    def _split(self, text: str) -> list[str]:
        """Tokens between white space. Where a special token stands, or a separator that only Python counts as white space, the cut is finer."""
        if self.at_special and self.at_special.search(text):
            out, at = [], 0
            for m in self.at_special.finditer(text):
                out += self._split(text[at : m.start()])
                out.append(m[0])
                at = m.end()
            return out + self._split(text[at:])
        if _ODD_SPACE.search(text):
            return re.sub(r"[^\S\x1c-\x1f]+", " ", text).strip(" ").split(" ") if text.strip(" ") else []
        return text.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, as little-endian 32-bit integers, and the text decoded from them."""
        cut = [self._split(t) for t in texts]
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = {t for tokens in cut for t in tokens}.difference(known)
        for t in [t for t in new if t in old]:
            known[t] = old[t]
            new.discard(t)
        for t in new.intersection(self.special):
            known[t] = (struct.pack("<I", self.special[t]), t)
            new.discard(t)
        self._learn(new)
        out = []
        for tokens in cut:
            got = list(map(known.__getitem__, tokens))
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        for t in new:
            if len(t) > self.LONGEST:
                del known[t]
                for w in self._words(t):
                    self.words.pop(w, None)
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(self.names[i] for (i,) in struct.iter_unpack("<I", ids))


#: Characters that one step encodes and gives out; a longer text is a step of its own.
CHUNK = 1 << 20

_OUT = "doc_id long, n_tokens long, ids binary, decoded string"


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids (little-endian 32-bit integers) and decoded, the text of those ids.

    path: the driver's copy of a tokenizers file of a BPE with word ends; its bytes are broadcast, a fixed size. A null or
    empty text, or one of white space alone, has no tokens and decodes to the empty text. Repeated rows each get their row; other columns are ignored.
    """
    with open(path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("bpe", hash(held.value)), lambda: Codec(held.value))
        for b in batches:
            for ids, texts in chunks(b, CHUNK):
                got = codec.encode(texts)
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                    pa.array([i for i, _ in got], pa.binary()),
                    pa.array([t for _, t in got], pa.string()),
                ]
                yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids", "decoded"])
            trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(coded, _OUT)
