"""BPE encoding and decoding over a minimal acyclic transducer of whole words, with exact merges for all others."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrule.llm.common import tidy
from tallyrule.llm.near_dedup import batches_of_texts

SUFFIX = "</w>"
#: White space as the tokenizer's pattern engine sees it; str.split() also cuts at \x1c-\x1f, so those texts take this pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ODD = regex.compile("[\x1c-\x1f]")
#: Letters beyond these old blocks may be classed by another Unicode version here than in the library, which then cuts the word.
NEWER = regex.compile(r"[^\x00-\u0557\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
SPLIT = regex.compile(f"[{WHITE}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Automaton:
    """A minimal acyclic automaton over byte strings whose accepting paths number their words (a perfect hash); outputs by number.

    Built from sorted words in one pass (Daciuk et al., 2000), stored as one flat file, read through a memory map.
    """

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.int32, "r")
        states, edges, words = (int(x) for x in raw[:3])
        cuts = np.cumsum([3, states + 1, states, edges, edges, edges, words])
        self.first, self.final, self.label, self.target, self.skip, self.out = (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))

        self.seen: dict[int, tuple[int, dict[int, tuple[int, int]]]] = {}

    def state(self, s: int) -> tuple[int, dict[int, tuple[int, int]]]:
        """(whether it accepts, label to (target, words before)), taken from the map when the state is first met."""
        lo, hi = int(self.first[s]), int(self.first[s + 1])
        edges = dict(zip(self.label[lo:hi].tolist(), zip(self.target[lo:hi].tolist(), self.skip[lo:hi].tolist(), strict=True), strict=True))
        self.seen[s] = int(self.final[s]), edges
        return self.seen[s]

    def __call__(self, word: bytes) -> int:
        """The word's output, or -1."""
        s, n, seen = 0, 0, self.seen
        for b in word:
            edge = (seen.get(s) or self.state(s))[1].get(b)
            if edge is None:
                return -1
            s, before = edge
            n += before
        return int(self.out[n]) if (seen.get(s) or self.state(s))[0] else -1

    @staticmethod
    def write(words: dict[bytes, int], path: str) -> None:
        items = sorted(words.items())
        register: dict[tuple, int] = {}
        done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []  # states in the order they became fixed

        def fix(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        path_nodes: list[list] = [[False, []]]
        last = b""

        def close(depth: int) -> None:
            while len(path_nodes) > depth + 1:
                node = path_nodes.pop()
                path_nodes[-1][1].append((last[len(path_nodes) - 1], fix(node)))

        for word, _ in items:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            path_nodes += [[False, []] for _ in range(len(word) - same)]
            path_nodes[-1][0] = True
            last = word
        close(0)
        root = fix(path_nodes[0])
        count = [0] * len(done)
        for s, (final, edges) in enumerate(done):  # targets come before their sources
            count[s] = final + sum(count[t] for _, t in edges)
        order = [root, *(s for s in range(len(done)) if s != root)]
        number = {s: i for i, s in enumerate(order)}
        first, final_, label, target, skip = [0], [], [], [], []
        for s in order:
            final, edges = done[s]
            before = int(final)
            for b, t in edges:
                label.append(b)
                target.append(number[t])
                skip.append(before)
                before += count[t]
            final_.append(int(final))
            first.append(len(label))
        flat = [len(order), len(label), len(items), *first, *final_, *label, *target, *skip, *(v for _, v in items)]
        with open(f"{path}.{os.getpid()}", "wb") as f:
            f.write(np.array(flat, np.int32).tobytes())
        os.replace(f"{path}.{os.getpid()}", path)


class Merges:
    """Exact merges of words: of all adjacent pairs the one of the lowest rank is merged, of equal ranks the leftmost, until none is left.

    Short words are merged together, each by one pair a round, in arrays; a longer one by a heap of pairs over a linked list.
    """

    NONE = np.iinfo(np.int64).max

    def __init__(self, vocab: dict[str, int], merges: list, symbols: list[str], short: int = 48) -> None:
        self.size, self.short = len(vocab), short
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.table = {(vocab[x], vocab[y]): (rank, vocab[x + y]) for rank, (x, y) in enumerate(pairs)}
        keys = np.array([x * self.size + y for x, y in self.table], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.array([r for r, _ in self.table.values()], np.int64)[order]
        self.made = np.zeros(len(pairs), np.int64)
        for rank, i in self.table.values():
            self.made[rank] = i
        self.inner = np.array([vocab[x] for x in symbols], np.int64)
        self.last = np.array([vocab[x + SUFFIX] for x in symbols], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE where they do not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [self.long(w) if len(w) > self.short else [] for w in words]
        some = [i for i, w in enumerate(words) if 0 < len(w) <= self.short]
        for k in range(0, len(some), 1 << 15):
            part = some[k : k + (1 << 15)]
            for i, ids in zip(part, self.many([words[i] for i in part]), strict=True):
                out[i] = ids
        return out

    def many(self, words: list[bytes]) -> list[list[int]]:
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[data]
        ends = np.cumsum(size)
        sym[ends - 1] = self.last[data[ends - 1]]
        who = np.arange(len(words))
        done: list[list[int]] = [[]] * len(words)
        # with each symbol, the rank of its pair with the next one; the last of a word has none
        rank = np.full(len(sym), self.NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[ends - 1] = self.NONE
        while len(who):
            starts = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, starts)
            over = low == self.NONE
            if over.any():
                flat = sym.tolist()
                for k in np.flatnonzero(over).tolist():
                    done[who[k]] = flat[starts[k] : starts[k] + size[k]]
                left = np.repeat(~over, size)
                sym, rank, who, size, low = sym[left], rank[left], who[~over], size[~over], low[~over]
                if not len(who):
                    break
                starts = np.cumsum(size) - size
            ends = starts + size - 1
            hit = np.flatnonzero(rank == np.repeat(low, size))
            at = hit[np.searchsorted(hit, starts)]  # the leftmost in each word
            sym[at] = self.made[low]
            more = at + 1 < ends
            rank[at] = self.NONE
            rank[at[more]] = self.ranks(sym[at[more]], sym[at[more] + 2])
            back = at[at > starts]
            rank[back - 1] = self.ranks(sym[back - 1], sym[back])
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            sym, rank, size = sym[left], rank[left], size - 1
        return done

    def long(self, word: bytes) -> list[int]:
        sym = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        n, table = len(sym), self.table
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(x[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (x := table.get((sym[i], sym[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if sym[i] != x or j < 0 or sym[j] != y:
                continue  # one of the two has gone into another pair
            sym[i], sym[j] = table[x, y][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := table.get((sym[i], sym[k])):
                    heapq.heappush(heap, (found[0], i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (found := table.get((sym[h], sym[i]))):
                heapq.heappush(heap, (found[0], h, sym[h], sym[i]))
        return [x for x in sym if x >= 0]


#: Ids and tokens of a stretch of text, both joined by one space, and how many.
Coded = tuple[str, str, int]


class Codec:
    """Encodes and decodes as the tokenizer file's library does, without special tokens added.

    Special tokens standing in a text are found first, as they are. What lies between is normalised (NFC, lower case), cut into
    words, and each word is looked up in the automaton; a word that is not there is merged by the vocabulary's ranks. Texts are taken
    some at a time (learn), so that all their new words are merged together. The library normalises and cuts; it merges nothing.
    """

    def __init__(self, tokenizer_path: str, automaton_path: str | None, cache: int = 100_000, longest: int = 64) -> None:
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != SUFFIX or spec["decoder"] is not None or model.get("ignore_merges"):
            raise ValueError("a BPE file with word ends and no decoder is needed")
        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.normalize, self.cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in special.items()}
        self.special = special
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.piece = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.symbols = byte_symbols()
        self.back = {x: b for b, x in enumerate(self.symbols)}
        self.merges = Merges(self.vocab, model["merges"], self.symbols)
        self.lexicon = Automaton(automaton_path) if automaton_path else (lambda word: -1)
        #: Words and pieces of at most `longest` characters are kept, in two generations of `cache` entries: what is used again survives.
        self.limit, self.longest = cache, longest
        self.known: dict[str, Coded] = {}
        self.old: dict[str, Coded] = {}
        self.parts: dict[str, Coded] = {}
        self.old_parts: dict[str, Coded] = {}

    def coded(self, ids: list[int]) -> Coded:
        return " ".join(map(str, ids)), " ".join([self.token[i] for i in ids]), len(ids)

    def pieces(self, raw: str) -> list[str] | list[bytes]:
        """A stretch without white space, normalised and cut by the vocabulary's pattern."""
        clean = raw.lower() if raw.isascii() else self.normalize(raw)
        if NEWER.search(clean):
            return [bytes(map(self.back.__getitem__, mapped)) for mapped, _ in self.cut(clean)]
        return self.piece.findall(clean)

    def parted(self, pieces: Iterable[str | bytes]) -> dict[str | bytes, Coded]:
        """The pieces' codes: from those kept, from the automaton, else by merging all that are left together."""
        out: dict[str | bytes, Coded] = {}
        new = []
        for x in pieces:
            if (found := self.parts.get(x) or self.old_parts.get(x)) is None:
                raw = x if isinstance(x, bytes) else x.encode()
                if (one := self.lexicon(raw)) < 0:
                    new.append((x, raw))
                    continue
                found = str(one), self.token[one], 1
            out[x] = found
        for (x, _), ids in zip(new, self.merges([raw for _, raw in new]), strict=True):
            out[x] = self.coded(ids)
        return out

    def coded_words(self, words: list[str]) -> dict[str, Coded]:
        cuts = [self.pieces(raw) for raw in words]
        parts = self.parted({x for cut in cuts for x in cut})
        if len(self.parts) >= self.limit:
            self.old_parts, self.parts = self.parts, {}
        self.parts.update((x, c) for x, c in parts.items() if len(x) <= self.longest)
        out = {}
        for raw, cut in zip(words, cuts, strict=True):
            found = [parts[x] for x in cut]
            out[raw] = found[0] if len(found) == 1 else (" ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found]))
        return out

    def stretches(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """The special tokens of a text (True) and the words between them."""
        for k, part in enumerate(self.specials.split(text)) if self.specials else [(0, text)]:
            if k % 2:
                yield True, [part]
            else:
                yield False, [raw for raw in SPLIT.split(part) if raw] if ODD.search(part) else part.split()

    def both(self, texts: list[str | None]) -> Iterator[Coded]:
        """(ids, decoded text, how many) of each text."""
        cut = [list(self.stretches(text)) if text else [] for text in texts]
        words = {raw for stretches in cut for special, part in stretches if not special for raw in part}
        if len(self.known) >= self.limit:
            self.old, self.known = self.known, {}
        known = self.known
        known.update((raw, self.old[raw]) for raw in self.old.keys() & words if raw not in known)
        new = self.coded_words([raw for raw in words if raw not in known])
        known.update((raw, c) for raw, c in new.items() if len(raw) <= self.longest)
        new = {raw: c for raw, c in new.items() if len(raw) > self.longest}
        for stretches in cut:
            found: list[Coded] = []
            for special, part in stretches:
                if special:
                    found.append((str(self.special[part[0]]), part[0], 1))
                elif new:
                    found += [known.get(raw) or new[raw] for raw in part]
                else:
                    found += [known[raw] for raw in part]
            found = [x for x in found if x[2]]
            yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])

    def ids(self, text: str) -> list[int]:
        return [int(i) for i in next(self.both([text]))[0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, special tokens kept; ids that the vocabulary lacks are skipped."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def compile_lexicon(tokenizer_path: str, folder: str) -> str:
    """Write the automaton of all words that the vocabulary holds whole into a folder of the caller's, and return its path.

    Those are the words that were frequent when the vocabulary was made; each is checked to merge to its single id.
    """
    with open(tokenizer_path, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()[:16]
    codec = Codec(tokenizer_path, None)
    own = [(bytes(codec.back[c] for c in t[: -len(SUFFIX)]), i) for t, i in codec.vocab.items() if t.endswith(SUFFIX) and len(t) > len(SUFFIX)]
    merged = codec.merges([data for data, _ in own])
    path = os.path.join(folder, f"lexicon-{key}.bin")
    Automaton.write({data: i for (data, i), ids in zip(own, merged, strict=True) if ids == [i]}, path)
    return path


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Encode and decode every whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]).

    One narrow pass; each row stands alone, so repeated and null ids are as good as others. A null text counts as empty
    and has no ids. The automaton is made once a session in a new folder of the driver, sent as a file and memory-mapped; the tokenizer
    file is read at its path on each machine. Texts are taken about a megabyte at a time (or one longer text).
    texts=False leaves out the ids and the decoded text. An empty table gives an empty result; other columns are not read.
    """
    sc = df.sparkSession.sparkContext
    made = getattr(sc, "_tallyrule_lexicons", None)
    if made is None:
        made = sc._tallyrule_lexicons = {}
    if tokenizer_path not in made:
        path = compile_lexicon(tokenizer_path, tempfile.mkdtemp(prefix="tallyrule-lexicon-"))
        sc.addFile(path)
        made[tokenizer_path] = os.path.basename(path)
    name = made[tokenizer_path]
    kind = dict(df.dtypes)[id_col]
    fields = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def coded(batches):
        codec = Codec(tokenizer_path, SparkFiles.get(name))
        for (id_part,), part in batches_of_texts(batches, ("_id",)):
            n, ids_sha, decoded_sha, ids, decoded = [], [], [], [], []
            for i, d, k in codec.both(part):
                n.append(k)
                ids_sha.append(hashlib.sha256(i.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(d.encode()).hexdigest())
                if texts:
                    ids.append(np.array(i.split(), np.int32))
                    decoded.append(d)
            cols = [id_part, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if texts else []
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols)])

    def run(batches):
        was = gc.isenabled()
        gc.disable()  # the caches hold no cycles, and the collector would walk them again and again
        try:
            yield from coded(batches)
        finally:
            if was:
                gc.enable()

    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), fields)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), texts=False)
