"""Chat formatting as a prefix tree: conversations that begin alike share their first turns.

Each turn becomes `<s>role\\ntext</s>`; control strings inside roles and texts are broken up by a
backslash, which unescape() takes out again. Conversations are ordered by the hashes of their
turns, so those with a common beginning are neighbours and the order is a depth-first walk of the
tree. A pass over each sorted partition emits every node of the tree once (its tokens, where they
lie in the pack, the position id of the first, the intervals of the ancestors a token may attend
to, and the interval under the loss mask) and closes a pack when it is full, so that a first turn
shared by a third of all conversations is spread over as many packs as needed, each of which
repeats only that turn. Equal conversations are merged before the walk.

A conversation is read as a stream in turn order. One of more than PART_TURNS turns or PART_CHARS
characters is stored in parts, so no row grows with the longest conversation. A later part goes on
where the part before it ends: its position ids count on, and each of its nodes names in `before`
the leaf of the part before (null in a first part). A token attends to its node's ancestors in the
pack and to the whole path of that leaf, which is in the pack that lists the leaf, and so on back
to the first part.

Defined results: a null text or role is empty; rows that tie on turn follow each other by role and
text; a null turn comes first; rows with a null conv_id are one conversation; extra columns are
left out; an empty table gives no packs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.common import shuffle_partitions

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
LEARNT_ROLE = "assistant"
PACK_TOKENS = 65_536
PART_TURNS, PART_CHARS = 1024, 4_000_000

PATHS = "conv_id long, part int, last boolean, key binary, leaf string, before string, roles array<string>, texts array<string>"
NODES = "array<struct<start:int,end:int,position:long,loss_start:int,loss_end:int,parent:int,ancestors:array<struct<start:int,end:int>>,before:string>>"
PACKS = f"pack string, ids array<int>, nodes {NODES}, leaves array<struct<leaf:string,node:int>>"


def escape(text: str) -> str:
    """No control string is left in the result; unescape() gives the text back."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str) -> str:
    return "<s>" + escape(role).replace("\n", "\\\n") + "\n"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


@cache
def encoder(ranks: str):
    """Byte-level BPE from a file of ranks; made once in each worker."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns in order -> one row for each conversation (or part of a very long one)."""
    rows: list[tuple] = []
    open_id, part, chain, chars, before = object(), 0, b"", 0, None
    key, roles, texts = bytearray(), [], []

    def close(last: bool) -> None:
        if roles:
            rows.append((open_id, part, last, bytes(key), chain.hex(), before, list(roles), list(texts)))
        key.clear(), roles.clear(), texts.clear()

    size = 0
    for batch in batches:
        for conv, role, text in zip(batch["conv_id"].tolist(), batch["role"].tolist(), batch["text"].tolist()):
            conv = None if conv is None or conv != conv else int(conv)
            if conv != open_id:
                close(True)
                open_id, part, chain, chars, before = conv, 0, b"", 0, None
            elif len(roles) >= PART_TURNS or chars >= PART_CHARS:
                close(False)
                key.extend(chain[:8])
                part, chars, before = part + 1, 0, chain.hex()
            raw = role.encode("utf-8", "surrogatepass")
            chain = hashlib.blake2b(chain + len(raw).to_bytes(8, "big") + raw + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            key.extend(chain[:8])
            roles.append(role)
            texts.append(text)
            chars += len(text)
            size += len(text)
            if len(rows) >= 2000 or size > 16_000_000:
                yield _frame(rows)
                rows, size = [], 0
    close(True)
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "part", "last", "key", "leaf", "before", "roles", "texts"])
    return out.astype({"conv_id": "Int64"})


def paths(turns: DataFrame) -> DataFrame:
    """One row for each conversation or part, with the hashes along its path."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(_paths, PATHS)


def _starts(rows: DataFrame, ranks: str) -> DataFrame:
    """before, base: how many tokens lie on the path to each leaf at which a later part begins."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks).encode_ordinary
        for batch in batches:
            n = [sum(len(encode(x)) for r, t in zip(roles, texts) for x in (header(r), escape(t), "</s>")) for roles, texts in zip(batch["roles"], batch["texts"])]
            yield batch[["conv_id", "part", "leaf"]].assign(n=n)

    cut = rows.filter("not last").select("conv_id", "part", "leaf", "roles", "texts").repartition(shuffle_partitions(rows.sparkSession), "conv_id", "part")
    counted = cut.mapInPandas(count, "conv_id long, part int, leaf string, n long")
    base = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part"))  # one thin row a part
    return counted.select(F.col("leaf").alias("before"), base.alias("base")).dropDuplicates(["before"])


def packs(rows: DataFrame, ranks: str, pack_tokens: int = PACK_TOKENS) -> DataFrame:
    """Prefix trees of distinct paths, emitted depth-first. ranks: a tokenizer's file of ranks."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks).encode_ordinary
        ids, nodes, leaves, stack = [], [], [], []  # stack: (hash of the turn, index of its node)
        first = ""
        for batch in batches:
            out = []
            for key, leaf, before, base, roles, texts in zip(*(batch[c] for c in ("key", "leaf", "before", "base", "roles", "texts"))):
                hashes = [key[i : i + 8] for i in range(0, len(key), 8)]
                hashes = hashes[len(hashes) - len(roles) :]
                if len(ids) >= pack_tokens:
                    out.append((first, ids, nodes, leaves))
                    ids, nodes, leaves, stack = [], [], [], []
                first = leaf if not leaves else first
                shared = 0
                while shared < min(len(stack), len(hashes)) and stack[shared][0] == hashes[shared]:
                    shared += 1
                del stack[shared:]
                for h, role, text in zip(hashes[shared:], roles[shared:], texts[shared:]):
                    parent = stack[-1][1] if stack else -1
                    above = [(nodes[i][0], nodes[i][1]) for _, i in stack]
                    position = base + sum(b - a for a, b in above)
                    merged: list[tuple[int, int]] = []
                    for a, b in above:
                        if merged and merged[-1][1] == a:
                            merged[-1] = (merged[-1][0], b)
                        else:
                            merged.append((a, b))
                    start = len(ids)
                    ids.extend(encode(header(role)))
                    loss = len(ids)
                    ids.extend(encode(escape(text)))
                    over = len(ids) if role == LEARNT_ROLE else loss
                    ids.extend(encode("</s>"))
                    nodes.append((start, len(ids), position, loss, over, parent, merged, before))
                    stack.append((h, len(nodes) - 1))
                leaves.append((leaf, stack[-1][1]))
            if out:
                yield _packs(out)
        if leaves:
            yield _packs([(first, ids, nodes, leaves)])

    distinct = rows.dropDuplicates(["leaf"]).select("key", "leaf", "before", "roles", "texts")
    first, later = distinct.filter("before is null").withColumn("base", F.lit(0).cast("long")), distinct.filter("before is not null")
    distinct = first.unionByName(later.join(_starts(rows, ranks), "before").select(*first.columns))
    return distinct.repartitionByRange(shuffle_partitions(rows.sparkSession), "key", "leaf").sortWithinPartitions("key", "leaf").mapInPandas(walk, PACKS)


def _packs(rows: list[tuple]) -> pd.DataFrame:
    node = ("start", "end", "position", "loss_start", "loss_end", "parent", "ancestors", "before")
    pair = ("start", "end")
    return pd.DataFrame(
        [(p, i, [dict(zip(node, (*n[:6], [dict(zip(pair, a)) for a in n[6]], n[7]))) for n in ns], [{"leaf": x, "node": k} for x, k in ls]) for p, i, ns, ls in rows],
        columns=["pack", "ids", "nodes", "leaves"],
    )


LEAVES = "leaf string, n_turns long, turns string, loss string, formatted_chars long"


def read_back(trees: DataFrame, ranks: str) -> DataFrame:
    """Each leaf's conversation, decoded from the tokens of its own path and nothing else.

    turns: role, \\n, text and \\n of each turn; loss: all text under the loss mask, unescaped.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = encoder(ranks).decode
        for batch in batches:
            for ids, nodes, leaves in zip(batch["ids"], batch["nodes"], batch["leaves"]):
                ids, texts = ids.tolist(), {}
                out = []
                for leaf in leaves:
                    at, path = leaf["node"], []
                    while at >= 0:
                        path.append(at)
                        at = nodes[at]["parent"]
                    formatted, loss = [], []
                    for i in reversed(path):
                        n = nodes[i]
                        if i not in texts:
                            texts[i] = decode(ids[n["start"] : n["end"]]), decode(ids[n["loss_start"] : n["loss_end"]])
                        formatted.append(texts[i][0])
                        loss.append(unescape(texts[i][1]))
                    whole = "".join(formatted)
                    turns = turns_of(whole)
                    out.append((leaf["leaf"], len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(loss), len(whole)))
                yield pd.DataFrame(out, columns=["leaf", "n_turns", "turns", "loss", "formatted_chars"])

    return trees.mapInPandas(read, LEAVES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """By conversation: lengths and digests of what read_back() found on its path or paths.

    Digests of a whole path are made once for all equal conversations. Those in several parts are
    put together as a stream of parts, sorted within a partition.
    """
    thin = rows.select("conv_id", "part", "last", "leaf")
    whole = leaves.select("leaf", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    single = thin.filter("part = 0 and last").join(whole, "leaf").select(*[x.split()[0] for x in DIGESTS.split(", ")])

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_id, state, out = object(), None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                conv = None if r.conv_id is None or r.conv_id != r.conv_id else int(r.conv_id)
                if conv != open_id:
                    if state:
                        out.append(_closed(open_id, state))
                    open_id, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += r.n_turns
                state[1].update(r.turns.encode())
                state[2] += len(r.loss)
                state[3].update(r.loss.encode())
                state[4] += r.formatted_chars
        if state:
            out.append(_closed(open_id, state))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})

    many = thin.filter("not (part = 0 and last)").join(leaves, "leaf")
    many = many.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part").mapInPandas(stream, DIGESTS)
    return single.unionByName(many)


def _closed(conv: int | None, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
