"""Fill-in-middle, conversation trie and main text against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import main_text as M
from folioscope.llm.fill_in_middle import Blocks, fill_in_middle, restored
from folioscope.llm.prefix_trie import conversation_trie, prefix_names

from .test_operators import SCHEMA, awkward, listed, ordered

CLASH = ("key", "cut", "n", "a", "b", "h", "m", "t", "pos", "depth", "words", "x", "y", "q", "found", "score", "base", "part")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# -- fill-in-middle --------------------------------------------------------------------------

def forms_of(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i:8 * i + 8], 16) for i in range(4)]
    x, y = sorted(v % (len(units) + 1) for v in h[:2])
    pre, mid, suf = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_fill_in_middle(spark, block):
    rng = random.Random(3)
    rows = [r[:2] for r in awkward()]
    rows += [(5000 + i, "".join(rng.choice(["ab", "é", " ", "<", "<P>"[:2], "😀", "Zz\n", "\0", "S>"]) for _ in range(rng.randint(0, 80)))) for i in range(300)]
    rows += [(6000, "has <M> in it"), (6001, "<P>"), (6002, "<"), (6003, "é" * 3000), (6004, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [forms_of(i, t or "") for i, t in rows]
    got = fill_in_middle(clashing(docs), block=block)
    assert listed(got) == ordered(want)
    back = got.select("doc_id", restored(F.col("output"), F.col("form")).alias("text"))
    assert listed(back) == ordered([(i, t or "") for i, t in rows])


def test_blocks_find_every_cut():
    rng = random.Random(1)
    for size in (1, 2, 5, 16):
        text = "".join(rng.choice(["abc", "x", "é", "北", " ", "9"]) for _ in range(60))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        b = Blocks(np.frombuffer(text.encode(), np.uint8), size)
        assert b.units == len(units) and b.points == len(text)
        assert [b.cut(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


# -- conversation trie -------------------------------------------------------------------------

def trie_of(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, sums = defaultdict(int), {p: [0, 0] for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][0] += p not in kids
            sums[p[:d]][1] += saved
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), *sums[p], hashlib.sha256(
        ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()) for p, m in members.items()]


def conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(45), 61, 62, 63, 64, 65, 66, 67, -7, -20, 10 ** 12]:
        for t in range(rng.choice([1, 2, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", None, "", "long text of words", "x"])))
    rows += [(200, t, "user", f"turn {t % 3}") for t in range(150)] + [(201, t, "user", f"turn {t % 3}") for t in range(120)]
    rows += [(300 + i, t, "user", "same words") for i in range(40) for t in range(3)]
    rows += [(None, 1, "user", "nobody"), (400, None, "user", "null first"), (400, 0, "user", "then"), (400, -5, "user", "between"),
             (401, 2, "user", "twice"), (401, 2, "user", "twice"), (401, 2, "user", "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [2, 16, 256])
def test_conversation_trie(spark, chunk):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert listed(conversation_trie(clashing(df), chunk=chunk)) == ordered(trie_of(rows))


def test_names_depend_on_the_prefix_alone():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2 ** 63, (1, 16, 2), dtype=np.int64).view(np.uint64)
    start = np.zeros((1, 2), np.uint64)
    whole = prefix_names(start, keys)
    for width in (1, 2, 4, 8):
        assert (prefix_names(start, keys[:, :width]) == whole[:, :width]).all()
    other = keys.copy()
    other[0, 9] = other[0, 8]
    changed = (prefix_names(start, other) != whole).any(-1)[0]
    assert changed.tolist() == [i >= 9 for i in range(16)]
    assert (prefix_names(start + np.uint64(1), keys) != whole).any(-1).all()


# -- main text ---------------------------------------------------------------------------------

ARTICLE = "<p>The first paragraph, with a comma, is long enough to be scored well by anyone who reads it.</p><p>Second.</p>"
TEXT = "The first paragraph, with a comma, is long enough to be scored well by anyone who reads it.\nSecond."
COMMENT = "<p>A reader, long and wordy, with many, many commas, and nothing to add, says this, and that, and more of it.</p>"
PAGES = [
    (None, ""), ("", ""), ("   ", ""), ("plain &amp; &eacute;&#33; text", "plain & é! text"), ("<p>one<p>two", "one\ntwo"),
    ("<nav><a href=a>Home</a></nav><footer>end</footer>", ""),
    (f"<body><article><h1>Title</h1>{ARTICLE}</article>", f"Title\n{TEXT}"),
    (f"<main><h1>Title</h1><article>{ARTICLE}</article></main>", f"Title\n{TEXT}"),
    (f"<header><h1>Site</h1></header><article><header><h1>T</h1></header>{ARTICLE}<footer>tags</footer></article>", f"T\n{TEXT}"),
    (f"<div class='layout has-sidebar'><div>{ARTICLE}</div><div class=sidebar>{COMMENT}</div></div>", TEXT),
    (f"<article>{ARTICLE}</article><section id=comments><article class=comment>{COMMENT}</article></section>", TEXT),
    (f"<article>{ARTICLE}</article><div id='commentList'><article>{COMMENT}</article></div>", TEXT),
    (f"<div class='cookie-notice' role=dialog>{COMMENT}</div><div class=ad>{COMMENT}</div><div>{ARTICLE}</div>", TEXT),
    (f"<div>{ARTICLE}<ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Us</a></ul></div>", TEXT),
    (f"<form id=all><h1>T</h1><div>{ARTICLE}<input><button>Go</button></div></form>", f"T\n{TEXT}"),
    (f"<form><p>Subscribe, now, please</p></form><div>{ARTICLE}</div>", TEXT),
    ("<article><p>a <b>b</b>\n c&nbsp;d<br>e<!-- x --><script>if(1<2)'</p>'</script></p>text<div>in</div>after</article>", "a b c d e\ntext\nin\nafter"),
    ("<article><table><tr class=header><th>k<th>v<tr><td>1</td><td>2</table><ul><li>x<li>y</ul></article>", "k v\n1 2\nx\ny"),
    ("<article><pre class=code><span class=comment># note</span> x</pre><p>cut here <a href='unclo", "# note x\ncut here"),
    ("<article><p>1 < 2 &am &lt;b&gt; &notit; &#xD800;</p></article>", "1 < 2 &am <b> ¬it; �"),
    ("<title>t</title><div hidden>no</div><div style='display: none'>no</div><p>yes</p>", "yes"),
    (f"<article>{ARTICLE}</article>" * 2, f"{TEXT}\n{TEXT}"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert M.main_text(html)[0] == text


@pytest.mark.parametrize("html", ["<div>" * 30_000 + "x", "<p><b>" * 20_000 + "x", "<!--" * 100_000, '<a "' * 100_000, "</" * 50_000, "<li>a, b " * 50_000])
def test_odd_pages_end(html):
    M.main_text(html)


def test_extract(spark):
    rows = [(i, f"http://x/{i}", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>a"), (1, "http://x/1", "")]
    got = M.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).select("page_id", "url", "text", "n_chars")
    want = [(i, f"http://x/{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(None, None, "a", 1), (1, "http://x/1", "", 0)]
    assert listed(got) == ordered(want)


def test_pages_as_given(spark):
    """The given pages hold one article element of headings and paragraphs each."""
    from html import unescape
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in M.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]+>", " " if "br" in p else "", p)).split()) for p in re.split(r"</?(?:h1|p)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_empty(spark):
    for df in (fill_in_middle(spark.createDataFrame([], SCHEMA)), M.extract(spark.createDataFrame([], "page_id long, url string, html string")),
               conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))):
        assert df.collect() == []
