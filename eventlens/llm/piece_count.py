"""Operator 6: greedy longest-match piece counts by a linear automaton.

A trie of the vocabulary carries, for each node, a failure link and the number of
pieces popped when the link is taken.  Matching walks each byte once: where the trie
has no edge it adds the node's popped count and follows the link.  The pieces
themselves are never built; the counts equal those of repeatedly taking the longest
vocabulary entry that is a prefix of what is left.

A text is cut into the pre-tokeniser's words first (a piece never crosses a word);
every single byte is an entry, so a match always exists.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import bpe, common


def build_automaton(entries: list[bytes]) -> dict:
    """Tables of the automaton: edges[node * 256 + byte] -> node, link[node], pops[node].

    Bounded by the vocabulary's bytes.  Nodes are numbered breadth first, so a node's
    link, which spells a shorter string, is ready before the node is reached."""
    edges: dict[int, int] = {}
    depth, is_entry, parents = [0], [False], [(0, 0)]
    for e in sorted(set(entries), key=len):
        node = 0
        for byte in e:
            nxt = edges.get(node * 256 + byte)
            if nxt is None:
                nxt = edges[node * 256 + byte] = len(depth)
                depth.append(depth[node] + 1)
                is_entry.append(False)
                parents.append((node, byte))
            node = nxt
        if node:
            is_entry[node] = True
    link, pops = [-1] * len(depth), [0] * len(depth)
    for node in sorted(range(1, len(depth)), key=depth.__getitem__):
        parent, byte = parents[node]
        if is_entry[node]:
            link[node], pops[node] = 0, 1  # the whole string is one piece
            continue
        at, popped = link[parent], pops[parent]
        while at >= 0 and (at * 256 + byte) not in edges:
            popped += pops[at]
            at = link[at]
        if at >= 0:
            link[node], pops[node] = edges[at * 256 + byte], popped
    return {"edges": edges, "link": link, "pops": pops}


def count_pieces(automaton: dict, word: bytes) -> int:
    """Pieces of the greedy longest-match split of ``word``; -1 if it has none."""
    edges, link, pops = automaton["edges"], automaton["link"], automaton["pops"]
    node = total = 0
    for byte in word:
        while (nxt := edges.get(node * 256 + byte)) is None:
            if link[node] < 0:
                return -1
            total += pops[node]
            node = link[node]
        node = nxt
    while node:
        if link[node] < 0:
            return -1
        total += pops[node]
        node = link[node]
    return total


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words long, n_pieces long), one row per input row.

    A null or empty text has 0 words and 0 pieces.  Words are counted once per worker
    through a bounded cache; a word of any length takes time linear in its bytes."""
    vocabulary = bpe.load_vocabulary(path)
    added = set(vocabulary["added"].values())
    automaton = build_automaton([t for i, t in enumerate(vocabulary["bytes"]) if t and i not in added])
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        words = regex.compile(bpe.PIECES).findall

        def counts(fragment: str) -> int:
            """Words * 2**40 + pieces, so that one sum gives both."""
            found = words(fragment)
            return (len(found) << 40) + sum(count_pieces(machine, w.encode()) for w in found)

        cache = bpe.FragmentCache(counts)
        for batch in it:
            totals = [sum(cache.values_of(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t >> 40 for t in totals], pa.int64()), pa.array([t & ((1 << 40) - 1) for t in totals], pa.int64())],
                names=["id", "n_words", "n_pieces"])

    src = common.columns(docs, id=id_col, text=text_col)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_words long, n_pieces long").withColumnRenamed("id", id_col)
