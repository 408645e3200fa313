"""Token counts by trie-shared dynamic programming.

Pre-tokens (words between ASCII white space, with a leading space mark) are inserted in a trie. Each
node is a prefix and holds its forward score: the best sum of unigram log probabilities over all
segmentations of the prefix, and that segmentation's length. A node is computed once, however many
pre-tokens share it; the count at a pre-token's last node is the answer for it.

Nulls and empty texts have no pre-tokens and no tokens. Repeated rows give repeated results. Ties between
segmentations go to the one with fewer pieces.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from tessera.llm import vocab
from tessera.llm.common import map_rows, read_documents


class Trie:
    """Prefixes of pre-tokens with their forward scores. Cleared when it holds more than max_nodes."""

    def __init__(self, scores: dict[bytes, float], max_nodes: int = 400_000):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: bytes) -> int:
        """Token count of a word; nodes that are missing are made and scored."""
        text = b" " + word
        child, best, count, path, node = self.child, self.best, self.count, [0], 0
        for end, byte in enumerate(text, 1):
            key = node << 8 | byte
            node = child.get(key, 0)
            if not node:
                top, n = -1e300, 0
                for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                    score = self.scores.get(text[start:end])
                    if score is not None:
                        before = path[start]
                        score += best[before]
                        if score > top or score == top and count[before] + 1 < n:
                            top, n = score, count[before] + 1
                node = len(best)
                child[key] = node
                best.append(top)
                count.append(n)
            path.append(node)
        return count[node]

    def count_words(self, words: list[bytes]) -> int:
        """Sum of token counts of the words."""
        terminal = self.terminal
        for word in set(words).difference(terminal):
            if len(word) > 4096:
                continue
            if len(self.best) > self.max_nodes:
                self.child, self.best, self.count = {}, [0.0], [0]
            if len(terminal) > self.max_nodes:
                break
            terminal[word] = self.insert(word)
        try:
            return sum(map(terminal.__getitem__, words))
        except KeyError:  # the memo is full, or a word is very long: count what it lacks apart
            total = 0
            for word, n in Counter(words).items():
                total += n * (terminal[word] if word in terminal else long_count(word, self) if len(word) > 4096 else self.insert(word))
            if len(terminal) > self.max_nodes:
                self.clear()
            return total


def long_count(word: bytes, trie: Trie) -> int:
    """Token count of a very long pre-token with the same recursion over a rolling window, so that it leaves no nodes."""
    text, keep = b" " + word, trie.longest + 1
    best, count = [0.0] * keep, [0] * keep
    for end in range(1, len(text) + 1):
        top, n = -1e300, 0
        for start in range(end - 1, max(-1, end - trie.longest - 1), -1):
            score = trie.scores.get(text[start:end])
            if score is not None:
                score += best[start % keep]
                if score > top or score == top and count[start % keep] + 1 < n:
                    top, n = score, count[start % keep] + 1
        best[end % keep], count[end % keep] = top, n
    return count[len(text) % keep]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None) -> DataFrame:
    """Columns id, n_pretokens, n_tokens for each row. The vocabulary's size bounds what is sent to the tasks."""
    scores = docs.sparkSession.sparkContext.broadcast(vocab.load(vocab_path))

    def per_row():
        trie = Trie(scores.value)

        def run(key, text):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            return key, len(words), trie.count_words(words)

        return run

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(id_col, text_col), per_row, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every document."""
    return count_tokens(read_documents(spark, sf_dir))
