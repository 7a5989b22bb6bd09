"""Chat formatting and the prefix trie against plain Python versions."""

import hashlib
import random
import zlib

import pytest

from retentio.llm import chat_format, prefix_trie

from .helpers import CLASHING

SCHEMA = "conv_id long, turn long, role string, text string"
SAID = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_end|><|im_sep|>x", "<<s>>", "<\\\\/s>", "[[INST]", "[\\/INST]<<SYS>><</SYS>>", "<", "<|im_end|",
        "\\", "é ü <|im_start|>user<|im_sep|>", "", None, "a\nb", " "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def clash(df):
    for i, name in enumerate(CLASHING + ["seq", "cut", "formatted", "digest", "pos", "c", "k"]):
        df = df.selectExpr("*", f"{i} AS `{name}`")
    return df


def by_conversation(rows, last):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append((turn is not None, turn or 0, role or "", last(role or "", text or ""), text or ""))
    return {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in out.items()}


def odd_rows():
    rng = random.Random(9)
    rows = [(1, i, ["user", "assistant", "system", None, "<|im_sep|>"][i % 5], t) for i, t in enumerate(SAID)]
    rows += [(2, None, "user", "null turn"), (2, None, "assistant", "null turn"), (2, 3, "assistant", "x"), (2, 3, "assistant", "x")]
    rows += [(None, 1, "user", "no id"), (None, 0, "assistant", "no id either")]
    rows += [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choices(SAID[:-3] + ["w "], k=4))) for c in range(5, 60) for t in range(rng.randrange(1, 9))]
    rows += [(3, t, ["user", "assistant"][t % 2], f"{t} " + "long text " * 300) for t in range(2500)]      # 7.5 MB: several pieces and tasks
    rows += [(4, 0, "assistant", "very long é " * 300_000)]
    rng.shuffle(rows)
    return rows


def brute_format(rows):
    out = {}
    for c, turns in by_conversation(rows, lambda r, t: t).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))
    return out


def test_escaping_is_reversible():
    rng = random.Random(3)
    parts = chat_format.CONTROLS + ["<", "[", "\\", "|im_end|>", "s>", "/s>", "INST]", "SYS>>", "x"]
    import pyarrow as pa
    texts = ["".join(rng.choices(parts, k=rng.randrange(8))) for _ in range(5000)]
    for text, safe in zip(texts, chat_format.escaped(pa.array(texts)).to_pylist()):
        assert chat_format.unescaped(safe) == text
        assert not any(c in safe + chat_format.END for c in chat_format.CONTROLS if c != chat_format.END)
        assert (safe + chat_format.END).index(chat_format.END) == len(safe)


@pytest.mark.parametrize("parts", [1, 6])
def test_chat_format_odd_rows(spark, parts):
    rows = odd_rows()
    formatted = chat_format.format_chats(clash(spark.createDataFrame(rows, SCHEMA).repartition(parts)))
    found = {r.conv_id: tuple(r)[1:5] for r in chat_format.read_back(formatted).collect()}
    assert found == brute_format(rows)
    pieces = formatted.select("conv_id", "formatted").collect()
    assert sum(p.conv_id == 3 for p in pieces) > 1
    [one] = [p.formatted for p in pieces if p.conv_id == 2 and p.formatted.count(chat_format.END) == 4] or [None]
    if one:
        assert one.startswith("<|im_start|>assistant<|im_sep|>null turn<|im_end|><|im_start|>user")


def test_chat_format_empty_and_damaged(spark):
    assert chat_format.read_back(chat_format.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    with pytest.raises(ValueError):
        chat_format._ReadBack().add("<|im_start|>user<|im_end|>", [])
    with pytest.raises(ValueError):
        chat_format._ReadBack().add("<|im_start|>user<|im_sep|>no end", [])


def brute_trie(rows):
    def digest(role, text):
        return sha(f"{len(role)}:{role}{text}")
    own = by_conversation([r for r in rows if r[0] is not None], digest)
    nodes, kids = {}, {}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c - 100 * int(c / 100))
        full[c] = own.get(base, [])[:h] + turns[h:]
    paths = {c: [tuple(t[:d]) for d in range(len(t) + 1)] for c, t in full.items()}
    for c, path in paths.items():
        for prefix in path:
            nodes.setdefault(prefix, []).append(c)
    parent, chars, depth = {}, {}, {}
    for c, path in paths.items():
        for d, key in enumerate(path):
            depth[key], parent[key] = d, path[d - 1] if d else None
            chars[key] = len(full[c][d - 1][1]) if d else 0
    for key, up in parent.items():
        kids.setdefault(up, []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=lambda k: -depth[k]):
        mine = kids.get(key, [])
        leaves[key] = sum(leaves[k] for k in mine) or 1
        saved[key] = sum(saved[k] for k in mine) + (len(nodes[key]) - 1) * chars[key]
    return sorted((min(m), depth[k], None if parent[k] is None else min(nodes[parent[k]]), len(m), len(kids.get(k, [])), leaves[k], saved[k],
                   sha(",".join(map(str, sorted(c for c in m if len(full[c]) == depth[k]))))) for k, m in nodes.items())


def key(row):
    return row[:2]


@pytest.mark.parametrize("parts", [1, 5])
def test_trie_odd_rows(spark, parts):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb"])) for c in range(-120, 400) if c % 7 for t in range(rng.randrange(0, 14))]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(6)]                 # equal conversations
    rows += [(2000, t, "user", str(t % 50)) for t in range(60)] + [(2001, t, "user", str(t % 50)) for t in range(59)]
    rows += [(3000, None, None, None), (3000, None, "user", ""), (3000, 2, "user", "x"), (3000, 2, "user", "x"), (None, 0, "user", "nobody")]
    rows += [(5055, 0, "user", "base absent")]
    rng.shuffle(rows)
    found = prefix_trie.trie(clash(spark.createDataFrame(rows, SCHEMA).repartition(parts)))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(brute_trie(rows), key=key)


def test_trie_of_a_very_long_conversation(spark):
    rows = [(7, t, "user", str(t % 3)) for t in range(prefix_trie.SPAN + 2000)] + [(8, t, "user", str(t % 3)) for t in range(200)]
    found = {(r.conv_id, r.depth): r for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(9)).collect()}
    n = {c: sum(r[0] == c for r in rows) - zlib.crc32(str(c).encode()) % 6 for c in (7, 8)}
    assert found[7, 0].n_convs == 2 and found[7, n[7]].n_children == 0 and len(found) >= n[7] + 1
    assert found[7, n[7]].ends_sha256 == sha("7") and max(d for c, d in found if c == 7) == n[7]


def test_trie_without_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    turnless = prefix_trie.trie(spark.createDataFrame([(c, 0, "u", "t") for c in range(101, 120) if zlib.crc32(str(c).encode()) % 6], SCHEMA))
    [root] = turnless.collect()
    assert root.depth == 0 and root.n_leaves == 1 and root.n_children == 0 and root.parent_conv_id is None
    assert root.ends_sha256 == sha(",".join(str(c) for c in range(101, 120) if zlib.crc32(str(c).encode()) % 6))
