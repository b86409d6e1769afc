"""Cut texts, main texts of pages and periodic runs against plain Python over whole tables and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from gaitframe.llm import extract, middle, queries, runs
from pyspark.sql import functions as F
from test_operators import SCHEMA, SF, awkward

MARKED = ["a <P> b\nc", "x<S>y", "<M>", "<P\n<S\n<M\n", "\n", "\n\n\n", "a\r\nb\rc\n", "no end of line", "ä\n€\n\U0001f600\n" * 300, "line\n" * 1000 + "z"]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(200_000 + i, t) for i, t in enumerate(MARKED)]
    extra = spark.createDataFrame(awkward(), SCHEMA).unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    clash = spark.createDataFrame([(7, "t\nu\n", 5, 6, 7, "n")], "doc_id long, text string, h1 int, n int, output int, `a.b` string")
    return real.unionByName(extra, allowMissingColumns=True).unionByName(clash, allowMissingColumns=True).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text").collect()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_checkpoints():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["\n", "a", "ß", "€", "\U0001f600"]) for _ in range(r.randint(0, 60)))
        raw, units = text.encode(), re.findall(r"[^\n]*\n|[^\n]+", text)
        for every, block in ((1, 7), (3, 5), (64, 1 << 20)):
            index = middle.Checkpoints(np.frombuffer(raw, np.uint8), every, block)
            assert (index.units, index.points) == (len(units), len(text))
            assert len(index.at_byte) <= len(units) // every + 1
            for u in range(len(units) + 1):
                head = "".join(units[:u])
                assert index.cut(u) == (len(head.encode()), len(head)), (text, u, every)


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (70, 100)])
def test_fill_in_middle(docs, rows, rate, spm):
    want = Counter()
    for r in rows:
        text = r.text or ""
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        n, x = len(units), sha(f"7:{'' if r.doc_id is None else r.doc_id}")
        h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
        u, v = sorted(y % (n + 1) for y in h[:2])
        pre, mid, suf = ("".join(units[a:z]) for a, z in ((0, u), (u, v), (v, n)))
        form, sizes, out = "plain", (None, None), text
        if text and not re.search("<[PSM]>", text) and h[2] % 100 < rate:
            form, sizes = ("spm" if h[3] % 100 < spm else "psm"), (len(pre), len(mid))
            out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
        want[r.doc_id, n, form, *sizes, out, text] += 1
    got = middle.fill_in_middle(docs, 7, rate, spm).select("*", middle.restored(F.col("output"), F.col("form")))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert middle.fill_in_middle(docs.where("false")).count() == 0


def test_fill_in_middle_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = queries.op11_fill_in_middle(spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()['op11_fill_in_middle']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)


def plain_runs(s, least, times):
    best = {}
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, z, p) for (a, z), p in best.items())


def some_strings(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        size, letters, s = r.randint(0, 120), r.choice([1, 2, 2, 3, 5]), []
        while len(s) < size:
            s += [r.randrange(letters) for _ in range(r.randint(1, 11))] * r.randint(1, 6)
            if r.random() < 0.3:
                a = r.randrange(len(s))
                s += s[a : a + r.randint(1, 50)]
        yield s[:size]


def test_runs_of_strings():
    met = 0
    for s in some_strings(3, 1500):
        for least, times in ((24, 3), (6, 3), (4, 2), (10, 4), (1, 2)):
            want = plain_runs(s, least, times)
            assert runs.runs_of(s, least, times) == want, (s, least, times)
            cut = [(a + x, a + y, p) for a, z in runs.stretches(np.array(s, np.int64), least, times) for x, y, p in runs.runs_of(s[a:z], least, times)]
            assert cut == want, (s, least, times)
            met += len(want)
    assert met > 10_000
    fibonacci, b = [0], [0, 1]
    while len(b) < 1500:
        fibonacci, b = b, b + fibonacci
    assert runs.runs_of(b, 2, 2) == plain_runs(b, 2, 2)


def test_factors():
    for s in some_strings(4, 400):
        at = 0
        for a, z, source in runs.Automaton(s).factors(s):
            assert a == at < z
            if source >= 0:
                assert source < a and s[source : source + z - a] == s[a:z]
            longest = max((k for p in range(a) for k in range(len(s) - a + 1) if s[p : p + k] == s[a : a + k]), default=0)
            assert z - a == max(1, longest) and (source >= 0) == (longest > 0)
            at = z
        assert at == len(s)


def judged(doc_id, words):
    found = plain_runs(words, 24, 3)
    gone, best = set(), None
    for a, z, p in found:
        gone |= set(range(a + p, z))
        if best is None or (z - a) * best[2] > (best[1] - best[0]) * p:
            best = (a, z, p)
    shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, sha("".join(f"{a},{z - a},{p}\n" for a, z, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def planted(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def test_periodic_runs(spark, docs):
    # long texts take plain_runs too long; test_runs_of_strings has their kinds of runs
    short = docs.where("text IS NULL OR length(text) < 12000")
    listed = [(r.doc_id, [w for w in re.split("[ \t\n\x0b\x0c\r]+", r.text or "") if w]) for r in short.collect()]
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = Counter(tuple(r) for r in runs.periodic_runs(short).select(*cols).collect())
    assert got == Counter(judged(d, w) for d, w in listed)
    made = Counter(tuple(r) for r in runs.periodic_runs(queries._made_periodic(short)).select(*cols).collect())
    assert made == Counter(judged(d, planted(d, w)) for d, w in listed)
    assert sum(k[1] > 0 for k in made) > len(listed) // 20
    assert runs.periodic_runs(docs.where("false")).count() == 0
    assert runs.periodic_runs(docs).count() == docs.count()


def test_periodic_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = Counter(judged(r.doc_id, planted(r.doc_id, (r.text or "").encode().decode().split())) for r in docs)
    assert Counter(tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()) == want


PAGES = [
    ("<article><h1>A &amp; B</h1><p>one <b>two\n\tthree</b><br>four<p>five&nbsp;six</p></article><footer>f</footer>", "A & B\none two three four\nfive six"),
    (None, ""),
    ("", ""),
    ("plain text, 1 < 2 &lt; 3 &#8364; &#x1F600; &am", "plain text, 1 < 2 < 3 € \U0001f600 &am"),
    ("<title>t</title><p>no head", "no head"),
    ("<html><head><style>p{}</style><script>var a='</p>';</script><body><main><p>m</p><aside>s</aside></main>", "m"),
    ("<main><div class='intro'>i</div><article>a<article class=x>reader</article></article></main>", "a"),
    ("<div class='cookie-notice'>c</div><div id=content><p>x<div class=sidebar>s</div>y</div><div class=comments>z</div>", "x\ny"),
    ("<div class='layout has-sidebar'><p>x</p></div>", "x"),
    ("<ul><li><a href=/>Home</a><li><a href=/a>About</a></ul><p>See <a href=b>this</a>.</p>", "See this."),
    ("<article><header><h1>H</h1></header><p>x</p><footer>tags</footer><form>mail<input></form><!-- <p>no</p> --></article>", "H\nx"),
    ("<article><p title='a>b'>x</p><table><tr><td>1<td>2<tr><th>3</table><ul><li>i<li>j</ul><pre>p  q</pre></article>", "x\n1 2\n3\ni\nj\np q"),
    ("<article><p>a</b></p></span>b</article>c", "a\nb"),
    ('<p>a <a href="x>y</a> b</p>', "a y b"),
    ("<script>never closed <p>x</p>", ""),
    ("<p>x</p><!-- never closed <p>y</p>", "x"),
    ("<ARTICLE><P>Upper &AMP; lower</P></ARTICLE>", "Upper & lower"),
    ("<article></article><p>outside of an empty article</p>", "outside of an empty article"),
    ("<div hidden>h</div><div style='display: none'>d</div><p>v</p>", "v"),
    ("<article>" + "<p>w" * 20_000 + "</article>", "\n".join(["w"] * 20_000)),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


def test_marked_pages(spark):
    table = [(i, f"http://h{i}.example/x", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>no url</p>"), (3, "http://h3.example/x", PAGES[3][0])]
    df = spark.createDataFrame(table, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("keys", F.lit(2)).withColumn("a.b", F.lit(3))
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extract.main_texts(df).collect())
    want = Counter((i, f"http://h{i}.example/x", t, len(t)) for i, (_, t) in enumerate(PAGES))
    want[None, None, "no url", 6] += 1
    want[3, "http://h3.example/x", PAGES[3][1], len(PAGES[3][1])] += 1
    assert got == want
    assert extract.main_texts(df.where("false")).count() == 0


def unmarked(r, n):
    """Pages without marks: text of their own between blocks that their host repeats, and copies."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    phrase = lambda k: " ".join(word() for _ in range(k))
    out = []
    for host in ("one.example", "two.example", "few.example"):
        top, note, foot = phrase(12), phrase(30), phrase(15)
        article = None
        for i in range(n if host != "few.example" else 2):
            if article is None or i % 5:  # every fifth page is a copy of the one before
                article = [phrase(r.randint(10, 60)) for _ in range(3)]
            html = f"<div>{top}</div><div><p>" + "</p><p>".join(article) + f"</p></div><div>{note}</div><div>{foot} page {i}</div>"
            own = "\n".join(article)
            out.append((len(out), f"http://{host}/{i}", html, own if host != "few.example" else "\n".join([top, own, note, f"{foot} page {i}"])))
    return out


def test_unmarked_pages(spark):
    table = unmarked(random.Random(8), 40)
    df = spark.createDataFrame([x[:3] for x in table], "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r for r in extract.main_texts(df).collect()}
    assert {k: v.text for k, v in got.items()} == {x[0]: x[3] for x in table}
    assert all(got[x[0]].n_dropped == (3 if "few" not in x[1] else 0) and got[x[0]].n_outside >= got[x[0]].n_repeated for x in table)
    # the size of a task's arrays changes nothing
    classes = [Counter(map(tuple, extract._strings(extract._parsed(df), 8, most).distinct().collect())) for most in (50, extract.HELD)]
    plain = Counter()
    for page_id, url, html, _ in table:
        _, maybe, no = extract.sorted_out(html)
        tokens = extract._Tokens().of(maybe + no)[0]
        host = extract._number(extract._host(url).encode()) - (1 << 63)
        page = extract._number(max([*maybe], key=len).encode()) - (1 << 63)
        for k in set(extract.keys(tokens, host, 8).view(np.int64).tolist()):
            plain[k, host, page] = 1
    assert classes == [plain, plain]


def test_marked_pages_meet_their_host(spark, monkeypatch):
    """Repeated blocks of main elements go, marked or not; articles keep what they share; every page meets the strings."""
    r = random.Random(9)
    phrase = lambda k: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(k))
    note, top = phrase(20), phrase(12)
    table, want = [], {}
    for i in range(60):
        own = [phrase(30), phrase(r.randint(10, 40))]
        zone = ("main", "div class='content'", "article")[i % 3]
        blocks = [own[0], note, own[1]]
        html = f"<div>{top}</div><{zone}>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</{zone.split()[0]}>"
        table.append((i, f"http://h.example/{i}", html))
        want[i] = "\n".join(blocks if zone == "article" else own)
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    for most in (50_000, 0):
        monkeypatch.setattr(extract, "MOST_BROADCAST", most, raising=False)
        got = {x.page_id: x for x in extract.main_texts(df).collect()}
        assert {k: v.text for k, v in got.items()} == want
        assert all(v.n_repeated == 32 and v.n_outside == 12 and v.n_dropped == (k % 3 < 2) for k, v in got.items())


def test_suffix_classes():
    r = np.random.default_rng(2)
    for width in (1, 2, 3, 5, 8):
        for _ in range(50):
            s = r.integers(0, 3, r.integers(1, 60)).astype(np.uint64)
            order, number = extract.suffix_classes(s, width)
            strings = [tuple(s[i : i + width].tolist()) for i in order]
            assert strings == sorted(tuple(s[i : i + width].tolist()) for i in range(len(s)))
            assert [a == b for a, b in zip(strings, strings[1:])] == [a == b for a, b in zip(number, number[1:])]
            assert sorted(order.tolist()) == list(range(len(s)))


def test_html_query(spark):
    """On the given tables an article element holds the main text: the same by plain string work."""
    from html import unescape

    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op12_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (r.url, text, len(text))
