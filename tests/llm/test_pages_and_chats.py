"""Main text of pages, preference pairs and dated lists against plain Python."""

import time

import numpy as np
import pytest

from evidark.llm import chat, extraction, train_labeller, url_lists
from evidark.llm.blocks import leaf_blocks
from evidark.llm.page_samples import Maker


def texts(page):
    return [b.text for b in leaf_blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b<br>c  <b>d</b>\n e<p>f</p>g<div>h<script>x<p>y</script></div>") == ["a & b c d e", "f", "g", "h"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- <p>no</p> -->&lt;e&gt; &nbsp; &#x41;") == ["a", "b", "c", "d", "<e> A"]
    assert texts("") == [] == texts("<p> </p>") == texts("<script>never ends")
    assert texts("text <p class='a>b'>in</p> 3 < 4 <i") == ["text", "in", "3 < 4"]


PAGE = "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav><div class='ad'>Buy it now.</div>{}<footer>&copy; me</footer></body></html>"
PROSE = "<h1>A title of the piece</h1><p>The first sentence stands here. It goes on.</p><p>And a second one &mdash; with more words in it.</p>"
WANT = "A title of the piece\nThe first sentence stands here. It goes on.\nAnd a second one — with more words in it."


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='post-body'>{}</div>", "<article>{}<div class='comments'><div class='comment'><p>I do not agree at all.</p></div></div></article>", "<article>{}</article><aside class='sidebar'><h3>Recent</h3><ul><li><a href='/y'>Other</a></li></ul></aside><form><label>Mail</label><button>Send</button></form>"])
def test_main_text(wrap):
    assert extraction.main_texts(extraction.trained(), [PAGE.format(wrap.format(PROSE))]) == [WANT]


def test_labels_on_unseen_pages():
    model, maker = extraction.trained(), Maker(4242)
    right = []
    for _ in range(150):
        blocks, labels = train_labeller.sample(maker)
        right += [bool(a) == bool(b) for a, b in zip(model.keep([blocks])[0], labels)]
    assert np.mean(right) > 0.98


@pytest.mark.parametrize("head", ["", "<title>A page</title>", "<html><head><title>A page of ours</title></head><body>"])
@pytest.mark.parametrize("n", [1, 2, 10, 100, 1000, 5000])
def test_short_blocks_from_the_start(head, n):
    got = extraction.main_texts(extraction.trained(), [f"{head}<article>" + "<p>Some words here.</p>" * n + "</article>"])
    assert got == ["\n".join(["Some words here."] * n)]


@pytest.mark.parametrize("head", ["", "<title>A page</title>"])
@pytest.mark.parametrize("body", ["<h1>Title</h1><p>Short news item.</p>", "<main><h1>Title</h1><p>Short news item.</p></main>", "<div class='content'><h1>Title</h1><p>Short news item.</p></div>"])
def test_short_pages(head, body):
    assert extraction.main_texts(extraction.trained(), [f"{head}<body>{body}</body>"]) == ["Title\nShort news item."]


def test_deep_and_long_pages():
    began = time.process_time()
    assert texts("<div class='a b'>" * 4000 + "deep") == ["deep"] and len(leaf_blocks("<div>x" * 4000)) == 4000
    assert time.process_time() - began < 1
    assert texts("<p><table><tr><td>a" + "<div>" * 3000 + "b") == ["a", "b"]
    model = extraction.trained()
    long = extraction.features(leaf_blocks("<article>" + "<p>Some words here.</p><p>And others, which say a little more.</p>" * 3000 + "</article><footer>x</footer>"))
    short = [extraction.features(leaf_blocks(PAGE.format(PROSE))), extraction.features(leaf_blocks("<p>one</p>"))]
    together = model.scores([long, *short])
    for page, s in zip([long, *short], together):
        whole = model.taped([page])[0][:, 0]  # all steps at once
        assert np.allclose(s, whole, atol=1e-3)


def test_one_step_by_hand():
    """Gates and state of one step, number by number."""
    rng = np.random.default_rng(3)
    lstm = extraction.Lstm(rng)
    x = (rng.random((2, 1, extraction.WIDTH)) < 0.1).astype(np.float32)
    got, _, _ = lstm.forward(x, np.ones((2, 1), np.float32))
    n, sigmoid = extraction.HIDDEN, lambda z: 1 / (1 + np.exp(-z))
    h, c = np.zeros(n), np.zeros(n)
    for t in range(2):
        z = [sum(x[t, 0, k] * lstm.wx[k, j] for k in range(extraction.WIDTH)) + sum(h[k] * lstm.wh[k, j] for k in range(n)) + lstm.b[j] for j in range(4 * n)]
        new_h, new_c = np.zeros(n), np.zeros(n)
        for j in range(n):
            new_c[j] = sigmoid(z[n + j]) * c[j] + sigmoid(z[j]) * np.tanh(z[3 * n + j])
            new_h[j] = sigmoid(z[2 * n + j]) * np.tanh(new_c[j])
        h, c = new_h, new_c
        assert np.allclose(got[t, 0], h, atol=1e-5)


def test_gradients_by_differences():
    maker = train_labeller.Maker(9)
    data = [d for d in (train_labeller.sample(maker) for _ in range(3)) if d[0]]
    pages, labels = [extraction.features(b) for b, _ in data], [l for _, l in data]
    model = extraction.Labeller()
    grads = model.step(pages, labels)

    def loss() -> float:
        s, mask = model.taped(pages)[:2]
        y = np.zeros_like(s)
        for k, l in enumerate(labels):
            y[: len(l), k] = l
        return float(((np.logaddexp(0, s.astype(np.float64)) - s * y) * mask).sum() / mask.sum())

    rng = np.random.default_rng(1)
    for p, g in zip(model.params(), grads):
        at = tuple(int(rng.integers(n)) for n in p.shape) if g.size < 100 else np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, e = p[at], 1e-2
        p[at] = kept + e
        up = loss()
        p[at] = kept - e
        down = loss()
        p[at] = kept
        assert abs((up - down) / (2 * e) - g[at]) < 2e-3 + 0.03 * abs(g[at])


def test_query_on_edges(spark, tmp_path):
    rows = [(1, "u", PAGE.format("<article>" + PROSE + "</article>"), "x"), (1, "u", None, "x"), (None, None, "", None), (2, None, "<p>" * 3000 + "deep", "y"), (3, "v", "<article>" + "<p>Some words here.</p>" * 5000 + "</article>", "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = extraction.op4_block_labeller(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text for r in got if r.page_id == 1) == ["", WANT]
    assert [r.text.count("\n") for r in got if r.page_id == 3] == [4999]
    spark.createDataFrame([], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert extraction.op4_block_labeller(spark, str(tmp_path)).count() == 0


def pair(spark, chosen, rejected):
    df = spark.createDataFrame([(chosen, rejected, "k")], "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt_id string")
    return chat.preference_rows(df).first()


def test_preference_rows(spark):
    u, a, b = ("user", "hé"), ("assistant", "yes"), ("assistant", "no")
    r = pair(spark, [u, a, u, b], [u, a, u, a])
    assert (r.n_prompt_turns, r.prompt_id) == (3, "k")
    assert r.prompt == "<|user|>\nhé<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\nhé<|end|>\n"
    lo, hi = map(int, r.chosen_mask.split(":"))
    assert r.chosen[lo:hi] == "no<|end|>" and r.rejected == "<|assistant|>\nyes<|end|>\n"
    same = pair(spark, [u, a], [u, a])
    assert (same.n_prompt_turns, same.chosen, same.rejected, same.chosen_mask) == (2, "", "", "")
    longer = pair(spark, [u, a, u, b], [u])
    spans = [tuple(map(int, s.split(":"))) for s in longer.chosen_mask.split(",")]
    assert longer.rejected == "" and [longer.chosen[x:y] for x, y in spans] == ["yes<|end|>", "no<|end|>"]
    none = pair(spark, None, [(None, None)])
    assert none.n_prompt_turns == 0 and none.rejected == "<|unknown|>\n<|end|>\n" and none.prompt == "" and none.chosen == ""
    assert pair(spark, [(None, "x")], [("unknown", "x")]).n_prompt_turns == 1


def test_reply_pairs_edges(spark, tmp_path):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "r"), (0, 1, "assistant", "r"), (0, 2, "user", "more"), (1, 0, "assistant", "s"), (2, 0, "user", None), (3, None, None, "t"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text AS reply")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op5_preference_formatting(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    assert (got[0].n_prompt_turns, got[0].chosen, got[0].rejected) == (1, "<|assistant|>\nr<|end|>\n", "<|assistant|>\ns<|end|>\n")
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected) == (1, "", "")
    df.where("false").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert chat.op5_preference_formatting(spark, str(tmp_path)).count() == 0


def test_dated_lists(spark):
    changes = [("bad.example.com", "block", "add", 100), ("bad.example.com", "block", "remove", 200), ("bad.example.com", "block", "add", 300), ("bad.example.com", "block", "add", 350),
               ("bad.example.com/ok", "allow", "add", 120), ("tie.com", "block", "add", 50), ("tie.com", "allow", "add", 50), ("x.com", "block", "add", 10), ("x.com", "block", "remove", 10), (None, "block", "add", 1), ("y.com", "block", "add", None)]
    urls = [(1, "http://www.bad.example.com/a", 150), (2, "http://bad.example.com:80/a", 200), (3, "HTTP://u@BAD.example.com./ok/z?q", 10**8), (4, "http://bad.example.com/okay", 300), (5, "http://tie.com", 50), (6, "http://x.com/", 99), (7, None, 5), (8, "no url", 5), (9, "http://bad.example.com/", None), (1, "http://www.bad.example.com/a", 150), (10, "http://notbad.example.com/", 150), (11, "http://bad.example.com/", 99)]
    c = spark.createDataFrame([u + ("v",) for u in urls], "id long, url string, fetched long, verdict string")
    l = spark.createDataFrame(changes, "pattern string, list string, action string, at long")
    got = sorted((r.row.id, r.judged.verdict, r.judged.n_active) for r in url_lists.judge(spark, c, l).collect())
    assert got == [(1, "block", 1), (1, "block", 1), (2, "none", 0), (3, "allow", 2), (4, "block", 1), (5, "allow", 2), (6, "none", 0), (7, "none", 0), (8, "none", 0), (9, "none", 0), (10, "none", 0), (11, "none", 0)]
    assert url_lists.judge(spark, c.where("false"), l).count() == 0
    assert {r.judged.verdict for r in url_lists.judge(spark, c, l.where("false")).collect()} == {"none"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([([("user", "hi")], [("user", "ho")], 1, "p", 2, "x")], "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, n_prompt_turns int, prompt string, prompt_input int, `a.b` string")
    got = chat.preference_rows(df)
    assert len(set(got.columns)) == len(got.columns) == 10
    r = got.first().asDict()
    assert (r["n_prompt_turns"], r["n_prompt_turns_input"], r["a.b"], r["prompt"]) == (0, 1, "x", "") and {"p", 2} <= set(r.values())
    only = df.select("chosen", "rejected")
    assert chat.preference_rows(only).columns == list(chat.MADE[:1]) + ["prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]


def test_list_entries_of_any_date(spark):
    captures = spark.createDataFrame([(1, "http://a.com/x", 1_700_000_000), (2, "http://a.com/y", 1_700_000_100), (3, None, 5)], "id int, url string, fetched long")
    changes = spark.createDataFrame([("a.com", "block", "add", 0), ("b.com", "block", "add", 1_700_000_000_000), ("a.com/x", "allow", "add", -(10**15)), ("a.com/y", "allow", "add", -(10**15)), ("a.com/y", "allow", "remove", 10)], "pattern string, list string, action string, at long")
    got = {r.id: (r.verdict, r.n_active) for r in url_lists.judge(spark, captures, changes).select("row.id", "judged.verdict", "judged.n_active").collect()}
    assert got == {1: ("allow", 2), 2: ("block", 1), 3: ("none", 0)}
    assert url_lists.judge(spark, captures.where("false"), changes).count() == 0
    assert [r.judged.verdict for r in url_lists.judge(spark, captures, changes.where("false")).collect()] == ["none"] * 3


def test_a_hot_pattern_in_many_tasks_and_extreme_dates(spark):
    import random

    rng = random.Random(4)
    changes = [(p, x, rng.choice(["add", "remove"]), rng.randint(0, 60)) for p in ("hot.com", "a.hot.com", "hot.com/x", "b.org") for x in ("block", "allow") for _ in range(9)]
    captures = [(i, rng.choice(["http://hot.com/x", "http://a.hot.com/y", "http://www.hot.com/", "https://b.org/"]), rng.choice([rng.randint(-5, 70), 30, 1_700_000_000_000, -(10**15)])) for i in range(1500)]

    def state(pattern, list_, t):
        past = sorted((at, action) for p, x, action, at in changes if (p, x) == (pattern, list_) and at <= t)
        return bool(past) and past[-1][1] == "add"

    def wanted(url, t):
        h, _, path = url.split("//")[1].partition("/")
        names = [".".join(h.split(".")[i:]) for i in range(h.count("."))] + ([f"{h}/{path}"] if path else [])
        active = [(len(p), x == "allow", p) for p in names for x in ("block", "allow") if state(p, x, t)]
        best = max(active, default=None)
        return (None, "none", 0) if best is None else (best[2], "allow" if best[1] else "block", len(active))

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = url_lists.judge(spark, spark.createDataFrame(captures, "id int, url string, fetched long"), spark.createDataFrame(changes, "pattern string, list string, action string, at long")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r.row.id: (r.judged.pattern, r.judged.verdict, r.judged.n_active) for r in out} == {i: wanted(u, t) for i, u, t in captures}
