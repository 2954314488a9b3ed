"""Chat, pages, embeddings, and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pitrank.llm import chat, html, lattice
from pitrank.llm.queries import op2_chat

LOG = "conv_id bigint, seq bigint, message string, kind string, role string, text string, formatted string"


def read_back(df):
    out = df.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.text_under_mask(F.col("formatted"), F.col("loss_spans"))})
    return {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in out.collect()}


def test_event_log_is_folded(spark):
    hard = "\\0 </s>[INST] <|end|> <<SYS>>\\1 \\ <| [/INST] 漢"
    rows = [(1, 0, "u", "start", "user", hard), (1, 1, "a", "start", "assistant", None), (1, 3, "a", "delta", None, "wor"), (1, 2, "a", "delta", None, "old "),
            (1, 4, "a", "regenerate", None, None), (1, 5, "a", "delta", None, "new "), (1, 6, "a", "delta", None, hard), (1, 7, "u", "edit", "user", hard + "!"),
            (1, 8, "x", "start", "user", "gone"), (1, 9, "x", "delete", None, None), (1, 10, "y", "start", "assistant", "back"), (1, 11, "y", "delete", None, None),
            (1, 12, "y", "regenerate", None, None), (1, 13, "y", "delta", None, "again"),
            (2, None, "m", "start", None, None), (None, 0, "m", "start", "assistant", ""), (3, 0, "only", "delta", "user", "no start"),
            (4, 0, "d", "start", "user", "a"), (4, 1, "d", "delta", None, "same"), (4, 1, "d", "delta", None, "same")]
    log = spark.createDataFrame([(*r, "clash") for r in rows], LOG).repartition(3)
    got = read_back(chat.format_chats(log))
    assert got == {1: ([("user", hard + "!"), ("assistant", "new " + hard), ("assistant", "again")], "new " + hard + "again"), 2: ([("", "")], ""),
                   None: ([("assistant", "")], ""), 3: ([("user", "no start")], ""), 4: ([("user", "asamesame")], "")}
    text = chat.format_chats(log).where("conv_id = 1").first().formatted
    assert text.count(chat.END) == 3 and "</s>" not in text and "[INST]" not in text
    assert chat.format_chats(log.where("false")).count() == 0


def test_query_reads_back_the_given_turns(spark):
    got = {r.conv_id: r for r in op2_chat(spark, "/root/testdata/sf0.001").collect()}
    told = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{told}\nassistant\n{told}\n".encode()).hexdigest()
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(told), hashlib.sha256(told.encode()).hexdigest())


PAGE = """<html><head><title>T</title><script>var x = "</p>";</script><style>p{}</style></head><body>
<header class="site-header">My site</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie notice"><p>We use cookies.</p></div><!-- <p>not here</p> -->
<article><h1>A  headline &amp; more</h1><p>First <b>bold</b>&nbsp;words &lt;tag&gt; here, as a long enough sentence.<p>Second one<br>goes on to the end of the paragraph.
<div class="ad">Buy this now.</div><ul><li>An item of the list that says something.</li><li>And another one of them.</li></ul></article>
<section class="comments"><div class="comment"><p>I liked it.</p></div></section><aside class="sidebar"><a href=/x>Related story</a></aside>
<form><label>Mail</label><button>Send</button></form><footer>&copy; site</footer>"""


def test_pages(spark):
    rows = [(i, f"u{i}", PAGE.replace("Home", f"Home{i}"), "clash") for i in range(6)] + [
        (10, None, None, "c"), (11, "", "", "c"), (12, "u", "<", "c"), (13, "u", "<p>&am", "c"), (14, "u", "<article><p>" + "long words. " * 40_000, "c"), (15, "u", "<script>", "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    model = html.fit_labeller(pages)
    out = {r.page_id: r for r in html.extract_main(pages, model).collect()}
    want = ("A headline & more\nFirst bold words <tag> here, as a long enough sentence.\nSecond one goes on to the end of the paragraph.\n"
            "An item of the list that says something.\nAnd another one of them.")
    assert [out[i].text for i in range(6)] == [want] * 6
    assert [out[i].text for i in (10, 11, 15)] == ["", "", ""]
    assert out[14].text == ("long words. " * 40_000).strip()
    assert html.extract_main(pages.where("false"), model).count() == 0


def test_text_behind_raw_tags_without_an_end():
    for tag in ('<svg width="1"/>', "<svg>", "<select>", "<object data=x>", "<noscript>", "<template>"):
        assert [b.text for b in html.blocks_of(f"<p>before</p>{tag}<p>the article</p>")] == ["before", "the article"], tag
    assert [b.text for b in html.blocks_of("<svg/><p>read</p><svg><text>not</text></svg><p>too</p>")] == ["read", "too"]
    for tag in ("script", "style", "textarea", "iframe"):
        assert [b.text for b in html.blocks_of(f"<p>before</p><{tag}><p>code</p>")] == ["before"], tag


def test_words_in_the_middle_of_a_block_decide_where_nothing_else_does():
    rng = np.random.default_rng(8)
    kinds = ["price offer discount order voucher".split(), "river winter council study village".split()]
    pages = []
    for _ in range(220):
        labels = rng.integers(0, 2, 8)
        texts = [" ".join(["it", "was", "then", *rng.choice(kinds[y], 8), "as", "we", "said."]) for y in labels]
        pages.append((html.vectors_of([html.Block(t, ("div", "p"), 0) for t in texts]), labels.astype(np.float32)))
    model = html.train_labeller(pages[:160], epochs=8)
    right = [(p >= 0.5) == (y > 0) for p, (_, y) in zip(html.label_pages([x for x, _ in pages[160:]], model), pages[160:])]
    assert np.mean(np.concatenate(right)) > 0.95


def test_labeller_on_unseen_made_pages():
    rng = random.Random(1)
    made = [html.made_page(rng) for _ in range(300)]
    model = html.train_labeller([(html.vectors_of(b), np.array(y, np.float32)) for b, y in made[:220]], epochs=10)
    right = [(p >= 0.5) == np.array(y, bool) for p, (_, y) in zip(html.label_pages([html.vectors_of(b) for b, _ in made[220:]], model), made[220:])]
    assert np.mean(np.concatenate(right)) > 0.95


def test_gradients_of_the_recurrent_labeller():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 5, html.WIDTH))
    mask, way = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], float), [rng.normal(0, 0.3, (html.WIDTH, 4 * html.HIDDEN)), rng.normal(0, 0.3, (html.HIDDEN, 4 * html.HIDDEN)), np.zeros(4 * html.HIDDEN)]
    into = rng.normal(size=(2, 5, html.HIDDEN))
    states, tape = html._read(x, mask, way, True)
    grads = html._unread(x, way, tape, into)
    for k, at in ((0, (3, 7)), (1, (2, 50)), (2, (45,))):
        way[k][at] += 1e-3
        up = (html._read(x, mask, way, False)[0].astype(float) * into).sum()
        way[k][at] -= 2e-3
        down = (html._read(x, mask, way, False)[0].astype(float) * into).sum()
        way[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-2 * max(1, abs(grads[k][at]))


def test_e8_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 8))
    found = lattice.decode_e8(x)
    own = ((x - found) ** 2).sum(1)
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS ** 2).sum(1), 2)
    assert all((((x - found - v) ** 2).sum(1) >= own - 1e-9).all() for v in lattice.NEIGHBOURS)


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    x = [v + rng.normal(0, s, 16) for v in base for s in (0, 0.05, 0.1, 0.2, 0.35)] + [base[0]] * 5 + [3 * base[1]] + [base[2] + rng.normal(0, 0.02, 16) for _ in range(60)]
    rows = [(i, [float(c) for c in v], i % 2, i) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [None, *[1.0] * 15]), (904, [float("nan")] * 16), (905, [float("inf"), *[1.0] * 15]), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [float(c) for c in base[5]])]
    table = spark.createDataFrame(rows + [(i, v, 0, 0) for i, v in odd], "vec_id bigint, embedding array<double>, label int, links int").repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_embeddings(table, block=16).collect())
    ids = [r[0] for r in rows] + [i for i, _ in odd]
    vec = [r[1] for r in rows] + [v for _, v in odd]
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vec]
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vec[i]) == len(vec[j]):
                a, b = np.array(vec[i]), np.array(vec[j])
                link[i, j] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9
    reach = link | np.eye(n, dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = Counter()
    for i in range(n):
        least = min((ids[j] for j in np.flatnonzero(reach[i]) if ids[j] is not None), default=None)
        want[(ids[i], int(link[i].sum()), least, ids[i] == least)] += 1
    assert got == want
    assert lattice.near_embeddings(table.where("false")).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = rng.normal(size=a.shape)
    u -= (u * a).sum(1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * u
    ka, kb = (lattice.cells(v, lattice.TABLES, lattice.PROBES, lattice.SCALE, 8) for v in (a, b))
    assert lattice._met_before(ka, kb, lattice.TABLES).mean() > 0.99


def test_pipeline_stages(spark):
    """Each stage against what it read, by brute force where that is possible."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "near_dedup", "mix", "pack"]
    extra = spark.createDataFrame([(None, None, None, None, None), (9001, "", None, None, 0), (9002, "12 34", "en", "src0", 5), (0, docs.first().text, "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(extra)
    from tests.llm.test_texts import WORD, components
    for name, stage in list(stages.items()):
        before = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        after = docs.collect()
        if name == "language_id":
            assert Counter(r.doc_id for r in after) == Counter(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
        elif name == "toxicity":
            gone = Counter(r["doc_id"] for r in before) - Counter(r.doc_id for r in after)
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert gone and sum(labels.get(d) == 0 for d in gone) <= 1
        elif name == "near_dedup":
            ids, sizes = components([(r["doc_id"], r["text"]) for r in before], 5)
            assert Counter(r.doc_id for r in after) == Counter(set(ids))
        elif name == "mix":
            words = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
            total, taken = sum(words.values()), sum(words[r.doc_id] for r in after)
            assert abs(taken - 1.5 * total) < 0.1 * total and max(Counter(r.doc_id for r in after).values()) <= 2
        else:
            assert sum(r.length for r in after if r.start == 0) and set(r.doc_id for r in after) == set(r["doc_id"] for r in before)
