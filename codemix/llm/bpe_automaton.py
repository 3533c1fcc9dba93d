"""BPE as a deterministic automaton over tokens, built by one gadget per merge.

The first automaton has one state with a loop for every base unit: it accepts every
sequence of units.  The gadget of a merge (u, v) -> t takes the state q that u leads to.
If q has an arc v, then u leads from now on to a copy of q without that arc, and every
state with an arc u gets an arc t, to where v led from q.  After all merges the automaton
accepts exactly the sequences that merging produces, one for every word.

Only the differences of a copy are stored: a state is known by its token and the merge that
made it.  ``arcs`` resolves arcs through these differences and ``follow`` keeps the
resolved ones in a table.  A word is encoded by transitions from left to right: its prefix
of every length is accepted along one path, so the last token of each prefix is the only
one that ends there and may follow the last token before it.  All words of a block step
together: a trie of the tokens gives the candidates, one column of positions moves at a time.
Decoding emits the labels of the arcs.

Texts are cut at white space, normalised and split into words by the rules of the tokenizer
file; each distinct chunk of a block is encoded once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from codemix.llm.common import ChunkIds, row_slices, text_buffer, thin

NEVER = 1 << 60
#: Bits of a worker's table of resolved arcs, and of its memory of chunks.
ARC_BITS, CHUNK_BITS = 20, 20
#: Units of a word that steps alone; shorter ones step together.
LONG_WORD = 256
#: Chunks that are encoded together, and bytes of a column that a worker handles at once.
STEP, SLICE = 8192, 1 << 20
ENCODED, DECODED = "ids", "decoded"


class Automaton:
    """States and arcs of a ranked merge list over the tokens 0 .. n - 1."""

    def __init__(self, tokens: dict[str, int], merges: list[tuple[str, str]], end: str):
        n = max(tokens.values(), default=-1) + 1
        self.end, self.left, self.right = end, [-1] * n, [-1] * n
        self.birth, self.live = [-1] * n, [False] * n
        self.gadgets: dict[tuple[int, int], int] = {}
        made = [self._joined(a, b) for a, b in merges]
        known = set(made)
        if len(known) < len(made):
            raise ValueError("two merges make the same token")
        for token, i in tokens.items():
            self.live[i] = token not in known
        for k, (pair, whole) in enumerate(zip(merges, made, strict=True)):
            u, v, t = tokens[pair[0]], tokens[pair[1]], tokens[whole]
            if any(self.left[x] < 0 and not self.live[x] for x in (u, v)):
                raise ValueError(f"merge {k} uses a token that a later one makes")
            self.left[t], self.right[t], self.birth[t] = u, v, k
            if self.live[u] and self.live[v] and self.arc(u, k - 1, v):
                self.live[t] = True
                self.gadgets[u, v] = k
        self._tables({t: i for t, i in tokens.items() if self.live[i]})

    def _tables(self, live: dict[str, int]) -> None:
        """Arrays for whole blocks: the gadgets by pair, and a trie of the live tokens over unit numbers."""
        n, end = len(self.left), self.end
        pairs = sorted((u * n + v, k) for (u, v), k in self.gadgets.items())
        self.pairs, self.merges = np.array([p for p, _ in pairs] or [-1]), np.array([k for _, k in pairs] or [NEVER])
        self.parts = np.array([self.left, self.right, self.birth])
        self.units = {t: k for k, t in enumerate(sorted(t for t in live if len(t) == 1))}
        self.number = np.full(max(map(ord, self.units), default=0) + 1, -1, np.int32)
        for unit, k in self.units.items():
            self.number[ord(unit)] = k
        children: list[dict[int, int]] = [{}]
        ends = {False: [-1], True: [-1]}  # token that ends at a node, inside and at the end of a word
        for token, i in live.items():
            last, node = token.endswith(end), 0
            for c in token[:-len(end)] if last else token:
                unit = self.units[c]
                if unit not in children[node]:
                    children[node][unit] = len(children)
                    children.append({})
                    ends[False].append(-1)
                    ends[True].append(-1)
                node = children[node][unit]
            ends[last][node] = i
        inner = [k for k, c in enumerate(children) if c]
        self.row = np.full(len(children), len(inner), np.int32)  # nodes without children share the last row
        self.row[inner] = np.arange(len(inner))
        self.next = np.full((len(inner) + 1, len(self.units)), -1, np.int32)
        for r, k in enumerate(inner):
            self.next[r, list(children[k])] = list(children[k].values())
        self.stop_at = np.array([ends[False], ends[True]], np.int32)
        self.arc_keys = np.full(1 << ARC_BITS, -1, np.int64)
        self.arc_values = np.zeros(1 << ARC_BITS, bool)

    @staticmethod
    def _joined(a: str, b: str) -> str:
        return a + b

    def arc(self, u: int, time: int, w: int) -> bool:
        """Whether the state that ``u`` led to after merge ``time`` has an arc ``w``.

        A gadget of (u, w) up to then took it away.  Otherwise the younger token decides: a
        token's states begin as copies of those of its right part, and an arc was given
        wherever its left part had one.
        """
        left, right, birth, gadgets = self.left, self.right, self.birth, self.gadgets
        while gadgets.get((u, w), NEVER) > time:
            if birth[w] > birth[u]:
                time = min(time, birth[w])
                w = left[w]
            elif birth[u] >= 0:
                time = min(time, birth[u] - 1)
                u = right[u]
            else:
                return True
        return False

    def arcs(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """``arc`` after all merges, for many pairs at once."""
        n, (left, right, birth) = len(self.left), self.parts
        out, at, time = np.zeros(len(u), bool), np.arange(len(u)), np.full(len(u), NEVER - 1)
        while len(at):
            key = u * n + w
            spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            gone = (self.pairs[spot] == key) & (self.merges[spot] <= time)
            loop = ~gone & (birth[u] < 0) & (birth[w] < 0)
            out[at[loop]] = True
            on = ~(gone | loop)
            at, u, w, time = at[on], u[on], w[on], time[on]
            younger = birth[w] > birth[u]
            time = np.minimum(time, np.where(younger, birth[w], birth[u] - 1))
            u, w = np.where(younger, u, right[u]), np.where(younger, left[w], w)
        return out

    def follow(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Whether tokens ``w`` may follow tokens ``u``, through the table of resolved arcs."""
        key = u.astype(np.int64) * len(self.left) + w
        slot = (key ^ (key >> 17)) & (len(self.arc_keys) - 1)
        missed = np.flatnonzero(self.arc_keys[slot] != key)
        out = self.arc_values[slot]
        if len(missed):
            new, back = np.unique(key[missed], return_inverse=True)
            found = self.arcs(new // len(self.left), new % len(self.left))
            out[missed] = found[back]
            to = (new ^ (new >> 17)) & (len(self.arc_keys) - 1)
            to, first = np.unique(to, return_index=True)
            self.arc_keys[to], self.arc_values[to] = new[first], found[first]
        return out

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and how many each has.  Words are not empty."""
        lens = np.array([len(w) for w in words], np.int64)
        stops = np.cumsum(lens)
        starts = stops - lens
        units = self.number[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        begin, end = np.repeat(starts, lens), np.repeat(stops, lens)
        last, since = np.full(len(units), -1, np.int64), np.zeros(len(units), np.int64)
        alone = np.flatnonzero(lens > LONG_WORD)
        for k in alone.tolist():
            self._step_alone(units, int(starts[k]), int(stops[k]), last, since)
        # candidates: every token that the trie finds from every position
        at = np.flatnonzero(end - begin <= LONG_WORD)
        node, ahead, found = np.zeros(len(at), np.int32), at, []
        while len(at):
            node = self.next[self.row[node], units[ahead]]
            on = node >= 0
            at, node, ahead = at[on], node[on], ahead[on] + 1
            token = self.stop_at[(ahead == end[at]).astype(np.int8), node]
            some = np.flatnonzero(token >= 0)
            found.append(np.stack([at[some], ahead[some], token[some]]))
            on = np.flatnonzero(ahead < end[at])
            at, node, ahead = at[on], node[on], ahead[on]
        if found:
            start, stop, token = np.concatenate(found, 1)
            depth = stop - begin[start]
            order = np.argsort(depth, kind="stable")
            start, stop, token, depth = start[order], stop[order], token[order], depth[order]
            for group in np.split(np.arange(len(depth)), np.flatnonzero(np.diff(depth)) + 1):
                s, e, t = start[group], stop[group], token[group]
                fits = s == begin[s]
                later = np.flatnonzero(~fits)
                fits[later] = self.follow(last[s[later] - 1], t[later])
                last[e[fits] - 1], since[e[fits] - 1] = t[fits], s[fits]
        on_path, at = np.zeros(len(units), bool), stops - 1
        first = starts
        while len(at):
            on_path[at] = True
            at = since[at] - 1
            keep = at >= first
            at, first = at[keep], first[keep]
        return last[on_path], np.add.reduceat(on_path, starts, dtype=np.int64) if len(lens) else lens

    def _step_alone(self, units: np.ndarray, start: int, stop: int, last: np.ndarray, since: np.ndarray) -> None:
        """The same for one long word, position by position."""
        known: dict[tuple[int, int], bool] = {}
        word, ends, row, after = units[start:stop].tolist(), self.stop_at, self.row, self.next
        tokens, begins = [-1] * len(word), [0] * len(word)
        for at in range(len(word)):
            node = 0
            for to in range(at, len(word)):
                node = int(after[row[node], word[to]])
                if node < 0:
                    break
                token = int(ends[int(to == len(word) - 1), node])
                if token < 0:
                    continue
                fits = at == 0
                if not fits:
                    pair = (tokens[at - 1], token)
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = self.arc(pair[0], NEVER - 1, token)
                if fits:
                    tokens[to], begins[to] = token, start + at
        last[start:stop], since[start:stop] = tokens, begins


class Codec:
    """The automaton of a tokenizer file, with its rules for cutting texts into words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        end, tokens = model.get("end_of_word_suffix"), model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        exact = not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if model["type"] != "BPE" or not end or spec["decoder"] or spec["post_processor"] or not plain or not exact:
            raise ValueError(f"{path} is no BPE file with word ends, plain added tokens and no decoder")
        units = {t for t in tokens if len(t) == 1}
        if len(units) != 256 or any(u + end not in tokens for u in units):
            raise ValueError(f"{path} lacks base units for some bytes")
        self.automaton = Automaton(tokens, merges, end)
        self.special = {a["content"]: a["id"] for a in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")"
                              if added else "(?!)")
        # the rules only: the merges stay out of the library
        self.rules = Tokenizer.from_str(json.dumps(spec | {
            "truncation": None, "padding": None, "added_tokens": [],
            "model": model | {"merges": [], "vocab": {t: i for t, i in tokens.items() if len(t) == 1}}}))
        self.chunks = ChunkIds(self._encoded, glued=False, bits=CHUNK_BITS)

    def _cut(self, text: str) -> list[tuple[str, int]]:
        """Words of a normalised text, as the units of their bytes, and where they start."""
        return [(w, at) for w, (at, _) in self.rules.pre_tokenizer.pre_tokenize_str(text)]

    def _normal(self, text: str) -> str:
        return text if self.rules.normalizer is None else self.rules.normalizer.normalize_str(text)

    def words(self, chunks: list[str]) -> list[list[str]]:
        """Words of chunks without white space or added tokens inside.

        Joined by spaces they are normalised and cut at once.  Where a rule sees other
        borders than the spaces, each is cut for itself.
        """
        text = self._normal(" ".join(chunks))
        parts = text.split(" ")
        if len(parts) != len(chunks):
            return [[w for w, _ in self._cut(self._normal(c))] for c in chunks]
        out: list[list[str]] = [[] for _ in chunks]
        stops = np.cumsum([len(p) + 1 for p in parts])
        cut = self._cut(text)
        owners = np.searchsorted(stops, [at for _, at in cut], "right").tolist()
        for owner, (word, _) in zip(owners, cut, strict=True):
            out[owner].append(word)
        return out

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        return [ids for a in range(0, len(chunks), STEP) for ids in self._step(chunks[a:a + STEP])]

    def _step(self, chunks: list[str]) -> list[list[int]]:
        parts, owners, fixed = [], [], {}
        for k, chunk in enumerate(chunks):
            for part in self.cut.split(chunk):
                if part:
                    if part in self.special:
                        fixed[len(parts)] = self.special[part]
                    parts.append(part)
                    owners.append(k)
        lists: list[list[str]] = [[]] * len(parts)
        plain = [j for j, p in enumerate(parts) if j not in fixed and len(p.split()) == 1 and p == p.strip()]
        for j, found in zip(plain, self.words([parts[j] for j in plain]), strict=True):
            lists[j] = found
        for j in set(range(len(parts))) - set(plain) - set(fixed):
            lists[j] = [w for w, _ in self._cut(self._normal(parts[j]))]
        number: dict[str, int] = {}
        for found in lists:
            for word in found:
                number.setdefault(word, len(number))
        tokens, counts = self.automaton.paths(list(number))
        stops = np.cumsum(counts).tolist()
        tokens, bounds = tokens.tolist(), [0, *stops]
        ids: list[list[int]] = [[] for _ in chunks]
        for j, (owner, found) in enumerate(zip(owners, lists, strict=True)):
            if j in fixed:
                ids[owner].append(fixed[j])
            for word in found:
                k = number[word]
                ids[owner].extend(tokens[bounds[k]:bounds[k + 1]])
        return ids

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text, in order; null counts as empty."""
        data, bounds = text_buffer(column)
        for a, b in row_slices(bounds):
            base = int(bounds[a])
            yield from self.chunks.ids(data[base:int(bounds[b])], bounds[a:b + 1] - base)


class Labels:
    """The label of every id of a tokenizer file without a decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["decoder"]:
            raise ValueError(f"{path} has a decoder")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.labels = np.array([names.get(i, "") for i in range(max(names) + 1)], object)

    def decode(self, ids: np.ndarray) -> str:
        """Labels of the arcs, with a space between."""
        return " ".join(self.labels[ids].tolist())


_MADE: dict[tuple[type, str], object] = {}


def once(kind: type, path: str):
    """The codec or the labels of a file, made once per worker."""
    if (kind, path) not in _MADE:
        _MADE.clear()
        _MADE[kind, path] = kind(path)
    return _MADE[kind, path]


def _added(rows: DataFrame, source: str, name: str, kind: DataType, run) -> DataFrame:
    """Rows with a column that ``run`` makes from slices of another; one of that name is replaced."""
    kept = rows.select(*[rows[c] for c in rows.columns if c != name or c == source])
    schema = StructType([*[f for f in kept.schema.fields if f.name != name], StructField(name, kind)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in thin(batches, source, SLICE):
            made = run(batch.column(source))
            columns = [c for c in batch.schema.names if c != name]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], made], [*columns, name])

    return kept.mapInArrow(step, schema)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``ids``: the token ids of ``text`` as packed unsigned 32-bit little-endian numbers.

    ``tokenizer`` is the path of a BPE tokenizer file with word ends that every executor can
    open.  No special tokens are added; those that a text spells become their ids.  Null,
    empty and blank texts have no ids.  Each row is encoded for itself, in its partition; other
    columns pass through, a column named ``ids`` is replaced.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([ids.astype("<u4").tobytes() for ids in once(Codec, tokenizer).encode(texts)], pa.binary())

    return _added(docs, "text", ENCODED, BinaryType(), run)


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Add ``decoded``: the text of ``ids`` as packed by ``encode``; null ids give null.

    A column named ``decoded`` is replaced.
    """

    def run(packed: pa.Array) -> pa.Array:
        show = once(Labels, tokenizer).decode
        return pa.array([None if p is None else show(np.frombuffer(p, "<u4")) for p in packed.to_pylist()], pa.string())

    return _added(rows, ENCODED, DECODED, StringType(), run)


def id_list(packed: Column) -> Column:
    """Packed ids as an array of bigint."""

    def run(column: pa.Array) -> pa.Array:
        rows = [None if p is None else np.frombuffer(p, "<u4").astype(np.int64) for p in column.to_pylist()]
        return pa.array(rows, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(packed)
