"""Site templates stay on their site: many hosts of very different size."""

import random

from pyspark.sql import functions as F

from millrace.llm import boilerplate as bp

PAGES = "doc_id string, title string, url string, text string, crawled_at int"
CHUNKS = "chunk_id string, doc_id string, title string, url string, text string"
ABOUT, FINDINGS = "About us", "Key findings"


def corpus():
    """(pages, lines that are not body): 60 hosts of 3 to 300 pages, each with its own menu, notice and footer."""
    r = random.Random(4)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u")]
    word = lambda: "".join(r.choice(syllables) for _ in range(3))
    pages, out = [], set()
    for h in range(60):
        n = (3, 5, 9, 20, 60, 300)[h % 6]
        name, menu = word(), [ABOUT, *(f"{word()} {word()}" for _ in range(4))]
        foot = f"Copyright {name} # {word()} {word()}"
        for k in range(n):
            doc = f"d{h}-{k}"
            title = ABOUT if h == 59 and k == 0 else f"{word()} {word()} {word()}"
            body = [title, *(" ".join(word() for _ in range(12)) + "." for _ in range(4))]
            if h == 6 or (h == 5 and k == 7):
                body.insert(2, FINDINGS)
            lines = [*menu, *body, f"This site of {name} uses cookies", foot]
            pages.append((doc, title, f"https://{name}{h}.example/p/{k}", "\n".join(lines), 1))
            out |= {(doc, i) for i in (*range(5), len(lines) - 2, len(lines) - 1)}
    return pages, out


def test_templates_are_of_their_host(spark):
    pages, want = corpus()
    # A page in two versions, and a mirror of a page of host 0 under another host.
    second = list(pages[-1])
    second[3] = "another first line of it.\nsecond body sentence of it goes on.\n" + second[3]
    mirror = ("mirror", "x", pages[-1][2], pages[40][3], 1)
    docs = spark.createDataFrame([*pages, tuple(second), mirror, pages[3]], PAGES)
    found = bp.not_body(docs, spark.createDataFrame([], CHUNKS)).collect()
    last = pages[-1][0]
    got = {(x.item_id, x.line_no) for x in found if x.item_id not in (last, "mirror")}
    # Host 6 has its subheading on each of its 3 pages, host 59 a page titled as its menu's first line.
    own = {(d, i) for d, i in want if d != last and not (d.startswith("d59-") and i == 0)}
    six = {(f"d6-{k}", 7) for k in range(3)}
    assert got - own <= six and len(own & got) >= 0.98 * len(own)
    assert ("d5-7", 0) in got and ("d5-7", 7) not in got
    texts = spark.createDataFrame([pages[-1], tuple(second)], PAGES)
    bodies = [x.text for x in bp.bodies(texts, "doc_id", bp.not_body(docs, spark.createDataFrame([], CHUNKS))).select("text").collect()]
    assert sorted(len(b.split("\n")) for b in bodies) == [6, 8]  # the exempt first menu line stays on that host
    assert any("second body sentence" in b for b in bodies)
    lines = mirror[3].split("\n")
    assert {x.line_no for x in found if x.item_id == "mirror"} >= {1, 2, 3, 4, len(lines) - 1}


def test_pages_without_a_host(spark):
    """A page whose url names no host joins the site whose lines it has; what belongs nowhere is one pool."""
    pages, want = corpus()
    docs = spark.createDataFrame(pages, PAGES).withColumn("url", F.when(F.col("doc_id").endswith("-1"), F.lit(None)).otherwise(F.col("url")))
    r = random.Random(9)
    pool = spark.createDataFrame([(f"n{k}", None, None, "Accept all\n" + " ".join("".join(r.choices("abcdefg", k=6)) for _ in range(9)) + ".", 1) for k in range(5)], PAGES)
    got = {(x.item_id, x.line_no) for x in bp.not_body(docs.unionByName(pool), spark.createDataFrame([], CHUNKS)).collect()}
    own = {(d, i) for d, i in want if d.endswith("-1") and int(d[1 : d.index("-")]) % 6 >= 2 and not (d.startswith("d59-") and i == 0)}
    assert own and len(own & got) >= 0.98 * len(own)
    assert {(f"n{k}", 0) for k in range(5)} == {x for x in got if x[0].startswith("n")}
