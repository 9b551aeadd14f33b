"""Token counts by a linear longest-match automaton.

Words are cut greedily into the longest pieces of a vocabulary, as word-piece tokenizers do. Only the number of
pieces is wanted, so none is built: the vocabulary is a trie; a node's failure link leads to the node for what is left over
once the longest pieces at its beginning are cut off, and the node stores how many pieces that cuts off. Each byte of a word
is then read once: while the trie has no way on, the count grows by the node's number and the walk goes on at its link.
A word that can't be cut up counts as one (unknown) token.

Words are ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes, led by ``prefix`` (a space, for vocabularies whose pieces begin with one). A
task remembers the counts of up to ``MEMORY`` words and then starts anew; this bounds memory and changes no result.

The vocabulary is read from the file that ``path`` names, on the driver, and has as many entries as a tokenizer's: its size does not
depend on the texts.

Defined results: null text has no words and no tokens; repeated rows are counted one by one. Input columns named like a
result column are replaced by it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.llm.common import Batches, bytes_of, prepare, query, rows_to_batch, schema_with, table, without

MEMORY = 1_000_000
PREFIX = b" "
#: Vocabulary of the query: a file of the public tokenizers of this environment.
VOCABULARY = "byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a rank file (``base64 rank`` lines) or of a JSON file with a ``vocab`` of UTF-8 pieces."""
    with open(path, "rb") as file:
        data = file.read()
    if path.endswith(".json"):
        found = json.loads(data)
        vocab = found.get("model", found).get("vocab", found)
        return [p.encode() for p in vocab]
    return [base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()]


class LongestMatch:
    """The automaton. Node 0 is the root; ``step`` maps (node << 8 | byte) to a node."""

    def __init__(self, pieces: Iterable[bytes]):
        self.step: dict[int, int] = {}
        ends = [False]
        order: list[tuple[int, int, int]] = []
        for piece in sorted({p for p in pieces if p}, key=lambda p: (len(p), p)):
            node = 0
            for byte in piece:
                nxt = self.step.get(node << 8 | byte)
                if nxt is None:
                    nxt = len(ends)
                    self.step[node << 8 | byte] = nxt
                    ends.append(False)
                    order.append((node, byte, nxt))
                node = nxt
            ends[node] = True
        # Parents before children: by depth.
        depth = [0] * len(ends)
        for parent, _, node in order:
            depth[node] = depth[parent] + 1
        #: Where a walk goes on after the pieces at its beginning are cut off (-1: it can't), and how many these are.
        self.link, self.cut = [-1] * len(ends), [0] * len(ends)
        for parent, byte, node in sorted(order, key=lambda x: depth[x[2]]):
            if ends[node]:
                self.link[node], self.cut[node] = 0, 1
                continue
            at, cut = self.link[parent], self.cut[parent]
            while at >= 0 and (nxt := self.step.get(at << 8 | byte)) is None:
                cut += self.cut[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.cut[node] = nxt, cut

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 if it can't be cut up."""
        step, link, cut = self.step.get, self.link, self.cut
        node = total = 0
        for byte in word:
            while (nxt := step(node << 8 | byte)) is None:
                total += cut[node]
                node = link[node]
                if node < 0:
                    return 1
            node = nxt
        # What is left must come out even.
        while node > 0:
            total += cut[node]
            node = link[node]
        return total if node == 0 else 1


def count_tokens(docs: DataFrame, vocabulary: list[bytes], text: str = "text", keep: list[str] | None = None, prefix: bytes = PREFIX, memory: int = MEMORY) -> DataFrame:
    """The ``keep`` columns (all, if None) with ``n_words``, ``n_bytes`` and ``n_tokens``."""
    prepare(docs.sparkSession)
    columns = without(docs.select(keep) if keep is not None else docs, "n_words", "n_bytes", "n_tokens")
    df = docs.select(*columns, *([] if text in columns else [text]))
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(vocabulary))

    def run(batches: Batches) -> Batches:
        automaton = shared.value
        known: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for body in bytes_of(batch.column(batch.schema.get_field_index(text))):
                words = body.split() if body else []
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= memory:
                            known.clear()
                        n = known[w] = automaton.count(prefix + w)
                    total += n
                rows.append((len(words), len(body or b""), total))
            parts = {name: pa.array([r[k] for r in rows], pa.int64()) for k, name in enumerate(("n_words", "n_bytes", "n_tokens"))}
            yield rows_to_batch(batch, columns, parts)

    return df.mapInArrow(run, schema_with(df, columns, *[T.StructField(n, T.LongType()) for n in ("n_words", "n_bytes", "n_tokens")]))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), read_vocabulary(vocabulary_path()), keep=["doc_id"])
