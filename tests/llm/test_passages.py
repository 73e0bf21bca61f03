import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import passages as P


def sentence(rnd, n=8):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + "."


def pieces(body):
    """Ends of the pieces of a sentence by the definition, in characters of ``body``."""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", body))
    c = [zlib.crc32("".join(x.lower() if "A" <= x <= "Z" else x for x in m.group()).encode()) for m in found]
    h = [((((x * 0x9E3779B97F4A7C15 + y) % 2**64) * 0xD6E8FEB86659FD93) % 2**64) >> 16 for x, y in zip(c, c[1:])]
    r = P.REACH
    return [found[i + 1].start() for i in range(r, len(h) - r) if all(h[i] < x for x in h[i - r : i]) and all(h[i] <= x for x in h[i + 1 : i + r + 1])]


def plain(rows, min_words):
    """Spans by the definition, over (doc_id, text) in order."""
    first, cut = {}, {}
    table = []
    for d, t in rows:
        at, parts = 0, []
        for m in list(re.finditer(r"\n|(?<=[.!?])[ \t\r\f\v]+", t or "")) + [None]:
            end = m.end() if m else len(t or "")
            stop = m.start() if m else end
            inner = [at, *(at + x for x in pieces((t or "")[at:stop])), stop]
            for a, b in zip(inner, inner[1:]):
                norm = " ".join(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")[a:b])))
                parts.append((a, end if b == stop else b, norm))
            at = end
        table.append((d, parts))
    for d, parts in sorted(table, key=lambda x: x[0]):
        for p in parts:
            first.setdefault(p[2], d)
    for d, parts in table:
        seen, runs, run = set(), [], []
        for a, b, n in parts + [(0, 0, "\0")]:
            if not n:
                continue
            if n != "\0" and (first[n] < d or n in seen):
                run.append((a, b, len(n.split())))
            else:
                if sum(r[2] for r in run) >= min_words:
                    runs.append((run[0][0], run[-1][1]))
                run = []
            seen.add(n)
        cut[d] = runs
    return cut


def test_spans_against_the_definition(spark, make_docs):
    rnd = random.Random(4)
    pool = [sentence(rnd) for _ in range(30)]
    rows = []
    for i in range(80):
        parts = [rnd.choice(pool) if rnd.random() < 0.5 else sentence(rnd, rnd.randint(1, 40)) for _ in range(rnd.randint(0, 12))]
        rows.append((i, "".join(p.upper() if rnd.random() < 0.2 else p + rnd.choice([" ", "\n", "\n\n", "  "]) for p in parts)))
    docs = make_docs(rows, {"removed": F.lit(1), "n_units": F.lit("x")})
    got = {r.doc_id: r for r in P.spans(docs.repartition(5), 20).collect()}
    want = plain(rows, 20)
    assert {d: [tuple(s) for s in r.removed] for d, r in got.items()} == want
    assert sum(map(len, want.values())) > 5
    for d, t in rows:
        left, at = "", 0
        for a, b in want[d]:
            left += t[at:a]
            at = b
        assert got[d].text == left + t[at:]


def test_a_passage_inside_a_line_goes_and_clean_text_stays(spark, make_docs):
    rnd = random.Random(9)
    shared = " ".join(sentence(rnd) for _ in range(8))
    rows = [(i, f"{sentence(rnd)} {shared} {sentence(rnd)}\nYes.\n{sentence(rnd)}") for i in range(40)] + [(i, f"{sentence(rnd)}\nYes.\n") for i in range(40, 60)]
    docs = make_docs(rows)
    out = {r.doc_id: r for r in P.without_repeats(docs).collect()}
    assert out[0].text == rows[0][1] and all(out[i].text == rows[i][1] for i in range(40, 60))
    for i in range(1, 40):
        assert shared not in out[i].text and out[i].text == rows[i][1].replace(shared + " ", "") and out[i].n_chars == len(out[i].text)


def test_a_passage_in_the_middle_of_a_sentence_goes(spark, make_docs):
    """50 to 100 words without a full stop, pasted between the words of other sentences."""
    rnd = random.Random(3)
    rows, clean = [], 30
    for i in range(60):
        shared = sentence(rnd, rnd.randint(50, 100)).rstrip(".")
        for k in range(2):
            rows.append((2 * i + k, f"{sentence(rnd, 30)} {sentence(rnd, rnd.randint(3, 12))[:-1]} {shared} {sentence(rnd, rnd.randint(3, 12))}\n{sentence(rnd, 40)}", shared))
    rows += [(200 + i, f"{sentence(rnd, 60)} {sentence(rnd, 30)}", "") for i in range(clean)]
    got = {r.doc_id: r for r in P.spans(make_docs([(d, t) for d, t, _ in rows])).collect()}
    cut = 0
    for d, t, shared in rows:
        r = got[d].removed
        if d >= 200 or d % 2 == 0:
            assert not r and got[d].text == t
            continue
        lo = t.index(shared)
        assert all(lo <= s.start and s.end <= lo + len(shared) + 1 for s in r)
        cut += len(r) == 1
        left = sum(len(w.split()) for w in (t[lo : r[0].start], t[r[0].end : lo + len(shared)])) if r else 0
        assert left <= 40
    assert cut >= 58


def test_rows_without_id_are_known_text_by_text(spark, make_docs):
    rnd = random.Random(5)
    shared, other = sentence(rnd, 40), sentence(rnd, 40)
    docs = make_docs([(1, shared), (2, other)] + [(None, f"{sentence(rnd, 5)} {shared}") for _ in range(4)] + [(None, other)])
    k = P.known_elsewhere(docs).collect()
    assert len(k) == 5 and len({r.part for r in k}) == 5
    assert sorted(len(r.text.split()) for r in P.spans(docs).where("doc_id is null").collect()) == [0, 5, 5, 5, 5]


def test_odd_rows(spark, make_docs):
    long = ("word " * 30 + ".\n") * 3000
    docs = make_docs([None, "", "\n \n", long, (None, long), (9, None), (9, long), (9, long)])
    got = P.spans(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].text is None and by[1][0].text == "" and by[2][0].removed == []
    assert by[3][0].text == long.split("\n")[0] + "\n" and by[None][0].text == ""
    kept = P.without_repeats(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [0, 1, 2, 3, 9]
    assert P.spans(docs.limit(0)).count() == 0
