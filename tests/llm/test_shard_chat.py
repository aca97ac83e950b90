import hashlib
import math
import zlib

from pyspark.sql import functions as F

from arbor.llm import chat, shard


def brute_place(tree, key):
    node, path = tree, ""
    while node.children:
        def draw(c, path=path):
            u = (int(hashlib.md5(f"{path}/{c.name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return -math.log(u) / c.total, c.name

        node = min((c for c in node.children if c.total > 0), key=draw)
        path = f"{path}/{node.name}"
    return node.shard


def test_shards_follow_the_tree_and_are_gapless(docs, rows):
    got = shard.shard_documents(docs, 16).collect()
    assert len(got) == len(rows)
    tree = shard.grid(16)
    for g in got:
        key = "null" if g.doc_id is None else str(g.doc_id)
        assert g.shard == brute_place(tree, key)
        assert g.grown_shard == brute_place(shard.grown(tree, 16), key) and g.grown_shard in (g.shard, 16)
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((g.doc_id if g.doc_id is not None else -1, g["size"], g.text_crc32) for g in got) == want
    for s in range(16):
        slots = sorted(g.slot for g in got if g.shard == s)
        assert slots == list(range(len(slots)))


def test_a_changed_weight_moves_rows_only_to_or_from_its_subtree(spark):
    one = shard.Node("", children=tuple(shard.Node(f"r{r}", children=tuple(shard.Node(f"s{2 * r + k}", 2 * r + k) for k in range(2))) for r in range(3)))
    heavy = shard.Node("", children=(*one.children[:2], shard.Node("r2", children=(one.children[2].children[0], shard.Node("s5", 5, 3.0)))))
    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    both = shard.place(shard.place(ids, one, F.col("k"), "a"), heavy, F.col("k"), "b").collect()
    moved = [x for x in both if x.a != x.b]
    assert moved and all(x.b in (4, 5) for x in moved)
    share = sum(x.b == 5 for x in both) / len(both)
    assert abs(share - 3 / 8) < 0.04


def test_no_documents(no_docs):
    assert shard.shard_documents(no_docs).collect() == []


CONVERSATIONS = [
    (1, 0, "system", "be ~0 brief <s>"), (1, 1, "user", "hi\nthere"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (1, 5, "user", "left over"), (2, 0, "user", "alone"), (3, 0, "assistant", "first ~1"), (3, 0, "assistant", "first ~1"), (None, 0, "odd\n[INST]role", "x"), (None, None, None, "y"), (4, 1, "assistant", "é" * 500), (4, 0, "user", "<<s>s>[INST[/INST]"),
]


def test_chat_round_trip(spark):
    c = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.format_prefix_targets(c.select("conv_id", "turn", "role", "text"))
    for e in examples.collect():
        if e.loss_start is not None:
            whole = e.context + e.target
            assert whole[e.loss_start - 3 : e.loss_start] == "<s>" and whole[e.loss_start + e.loss_chars :] == "</s>"
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by = {}
    for conv, turn, role, text in CONVERSATIONS:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(back) == set(by)
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert back[conv].n_turns == len(turns)
        assert back[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert back[conv].loss_chars == len(loss) and back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_control_conversation_and_native_plan(spark):
    c = chat.control_conversation(spark)
    (r,) = chat.read_back(chat.format_prefix_targets(c)).collect()
    assert r.conv_id == -1 and r.n_turns == 2 and r.loss_chars == len("</s>[INST] ok [/INST]")
    assert chat.read_back(chat.format_prefix_targets(c.where("false"))).collect() == []
