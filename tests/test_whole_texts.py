"""Text queries over whole documents and conversations, against brute force and by hand."""

import re

import pytest
from pyspark.sql import functions as F

from examlake.functions import markdown as M
from examlake.plans import catalog

SF = "/root/testdata/sf0.001"
ODD = ["", None, " \n\t", "# head\n**bold** and `code`\n* item", " $x$", "cost \\$5 and $a_1 \\le b$ end", "one\n\ntwo", "long word " * 20_000, "다음 그림 을 보라", "## 검산\nno\n## 끝\nyes"]
SAID = [("6번 5번 6번, 3단계 [3점] 2.7번 #9 문제 30 2번째 줄", [6, 5, 9], False, None), ("3번을 민지의 오답 노트에 추가해", [3], True, "민지"), ("4번 오답 노트 보여", [4], False, None), ("", [], False, None), (None, None, False, None)]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(k, t) for i, t in enumerate(ODD) for k in range(100_000 + 6 * i, 100_006 + 6 * i)]
    rows = spark.createDataFrame([(k, t, "s") for k, t in docs], "doc_id long, text string, source string")
    rows.write.parquet(str(at / "documents.parquet"))
    said = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text")
    said.unionByName(spark.createDataFrame([(900_000 + i, 0, s[0]) for i, s in enumerate(SAID)], said.schema)).write.parquet(str(at / "conversations.parquet"))
    return str(at), dict(docs)


def rows(spark, name, at):
    return catalog.queries()[name](spark, at).collect()


def tidy(text):
    """What is left of a text without marks: runs of blanks, blanks at line ends, blank lines and both ends are put in order."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", re.sub(r"[ \t]{2,}", " ", text))).strip()


VECTORS = {
    r"$x^2$ $x^{pq}$ **b** \$1": "x² x^(pq) b $1",
    r"$\frac{a+1}{2}$, $\dfrac12$": "(a+1)/(2), (1)/(2)",
    r"$\sqrt{x} + \sqrt[3]{y} + \sqrt[n]{z} + \sqrt[k$": "√(x) + ³√(y) + ⁿ√(z) + √([)k",
    r"$\alpha\delta\lambda\Omega\varphi$": "αδλΩφ",
    r"$A \subseteq B \Rightarrow \exists x \notin \mathbb{R}$": "A ⊆ B ⇒ ∃ x ∉ R",
    r"$90\circ 1 \le 2 \neq 3 \to \infty$": "90∘ 1 ≤ 2 ≠ 3 → ∞",
    r"$\left( a \right. \, b \! c \; d \\ e & f ~ g$": "( a b c d e f g",
    r"$\text{if } \mathrm{d}x \displaystyle \vec{AB} \sin \theta$": "if dx AB sin θ",
    r"$\begin{cases} x \end{cases}$ $a_{ij}$ $a_{q}$ $x^$": "x aᵢⱼ a_(q) x^",
    r"\[ x \] \( y \) $$z$$ $ $ $$$$ \( open": "x y z $ $ $$$$ open",
    "# head\n  * item\n- two  \n\n\n\n`c` **d** e  f ": "head\n  • item\n• two\n\nc d e f".replace("  •", " •"),
    "a $x\n\ny$ b": "a $x\n\ny$ b",
    "$" + "{" * 5000 + "x" + "}" * 5000 + "$": "x",
}


def test_plain_text_vectors():
    for source, want in VECTORS.items():
        got = M.segments(source)
        assert "".join(t for t, _ in got) == want, source
        assert all(latex is None or M.render(latex) == t for t, latex in got)


@pytest.mark.parametrize("piece", ["\\(", "\\[ x", "$", "$$", "{", "^{", "\\frac{", "\\sqrt[", "**a", "* ", "a  \n", "`"])
def test_plain_text_time_is_linear(piece):
    import time

    began = time.time()
    for source in (piece * (300_000 // len(piece)), "$" + piece * (300_000 // len(piece)) + "$"):
        M.segments(source)
    assert time.time() - began < 20


def test_plain_texts_and_all_segments_of_documents(spark, data):
    at, docs = data
    plain = {r["doc_id"]: r["plain"] for r in rows(spark, "p20_p21_document_plain_texts", at)}
    parts = {}
    for r in sorted(rows(spark, "p22_document_segments", at), key=lambda r: (r["doc_id"], r["pos"])):
        parts.setdefault(r["doc_id"], []).append((r["pos"], r["x"], r["latex"]))
    assert plain.keys() == docs.keys()
    compared = 0
    for k, t in docs.items():
        mine = parts.get(k, [])
        assert [p for p, _, _ in mine] == list(range(len(mine))) and "".join(x for _, x, _ in mine) == (plain[k] or "")
        if t is None:
            assert plain[k] is None and not mine
        elif not re.search(r"[\\$#*`_^{}+\-]", t):
            whole = bool(t.strip()) and not re.search(r"\n[ \t]*\n", t)
            want = [tidy(t), tidy(f"x² {t} (1)/(2)"), re.sub(r"\s+", " ", t).strip() if whole else tidy(f"$${t}$$")][k % 3]
            assert plain[k] == want
            if k % 3 == 1:
                assert mine[0][1:] == ("x²", "x^2") and mine[-1][1:] == ("(1)/(2)", r"\frac{1}{2}") and len(mine) == 3
            if k % 3 == 2 and whole:
                assert mine == [(0, want, t)]
            compared += 1
    assert compared > 100
    assert {plain[100_000 + 18 + j] for j in range(6) if (100_018 + j) % 3 == 0} == {"head\nbold and code\n• item"}
    assert {plain[100_000 + 30 + j] for j in range(6) if (100_030 + j) % 3 == 0} == {"cost $5 and a₁ ≤ b end"}


def test_mentions_and_intents_of_conversations(spark, data):
    at, _ = data
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{at}/conversations.parquet").collect()}
    mention = re.compile(r"(?:(?:문제|문항)\s*|#\s*)(?<![\d.,])(\d{1,3})|(?<![\d.,])(\d{1,3})(?=\s*번)(?!\s*번째\s*(?:줄|행|칸|단계|글자|문자|쪽|페이지|장|항))")
    for name in ("p23_conversation_mentions", "p24_conversation_intents"):
        got = {(r["conv_id"], r["turn"]): r for r in rows(spark, name, at)}
        assert got.keys() == texts.keys()
        for k, t in texts.items():
            adds = bool(re.search(r"오답\s*노트[에]?\s*(?:.*?)(추가|담|넣|저장|등록)", t or ""))
            numbers = None if t is None else list(dict.fromkeys(n for a, b in mention.findall(t) if 1 <= (n := int(a or b)) <= 22))
            if name.startswith("p23"):
                assert got[k]["numbers"] == numbers
            else:
                assert got[k]["adds"] == adds and got[k]["numbers"] == (numbers if adds else [])
    for i, (_, numbers, adds, note) in enumerate(SAID):
        r = got[900_000 + i, 0]
        assert (r["adds"], r["numbers"], r["note"]) == (adds, numbers if adds else [], note)


def brute_sections(answer):
    pieces, out = re.split(r"(?m)^[ \t]{0,3}##[ \t]+", answer)[1:], {}
    for p in pieces:
        title, _, body = p.partition("\n")
        out.setdefault(title.rstrip(" "), []).append(body.strip(" \t\n\x0b\f\r"))
    return [(t, "\n\n".join(b for b in bodies if b)) for t, bodies in out.items()]


def test_blocks_of_whole_documents(spark, data):
    at, docs = data
    got = {}
    for r in sorted(rows(spark, "b1_b2_b3_document_blocks", at), key=lambda r: (r["doc_id"], r["pos"])):
        got.setdefault(r["doc_id"], []).append((r["kind"], r["level"], r["text"]))
    for node in {k // 40 for k in docs}:
        mine = [(k % 40 + 1, k, docs[k]) for k in sorted(docs) if k // 40 == node]
        want, last = [("heading", 1, f"exam {node}")], []
        for no, k, t in mine:
            want.append(("heading", 2, f"{no}번"))
            text = k % 2 == 0 and bool((t or "").strip())
            want += [("text", None, t)] * text + [("image", None, None)] * (not text or "그림" in t)
            if k % 3 == 0 and t is not None:
                last.append(("heading", 2, f"{no}번"))
                for title, body in brute_sections(f"## 문제 확인\nq\n## 풀이\n{t}"):
                    if title not in ("문제 확인", "검산"):
                        last += [("heading", 3, title), ("text", None, body)]
        assert got[node] == want + ([("page_break", None, None), ("heading", 1, "정답 및 해설"), *last] if last else [])


def test_segments_as_rows(spark, monkeypatch):
    """Segments of up to 10,000 texts were in memory at once; now they leave as rows, in pieces."""
    monkeypatch.setattr(M, "ROWS", 3)
    rows = [(1, r"a $x^2$ b \(\frac{1}{2}\) c"), (2, None), (3, ""), (4, "plain"), (5, "$$y$$ " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, t string")
    got = M.segment_rows(df, "doc_id", "t")
    want = [(k, i, *s) for k, t in rows if t for i, s in enumerate(M.segments(t))]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want and "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()


def test_ordinary_characters_of_maths_are_read_in_runs(monkeypatch):
    """Each character of a formula was a token of its own, all of them kept at once."""
    calls, one = [], M._Reader.one
    monkeypatch.setattr(M._Reader, "one", lambda self: calls.append(1) or one(self))
    assert M.render(r"\frac ab" + " long  words, [and] more." * 20_000 + r" x^ 23 \text  {q {r}} \text") == r"(a)/(b)" + " long words, [and] more." * 20_000 + r" x²3 q {r} \text"
    assert len(calls) < 20


def test_texts_without_marks_stay_out_of_python(spark, monkeypatch):
    """The parser was given all rows, though its result was taken only for those with marks."""
    sent, inner = spark.sparkContext.accumulator(0), M.segments

    def counted(source):
        sent.add(1)
        return inner(source)

    monkeypatch.setattr(M, "segments", counted)
    rows = [(1, "plain words"), (2, None), (3, ""), (4, "a $x^2$"), (5, " b"), (6, "c\td. e")]
    got = spark.createDataFrame(rows, "k int, t string").select("k", M.plain(F.col("t")).alias("p")).collect()
    assert {r["k"]: r["p"] for r in got} == {1: "plain words", 2: None, 3: "", 4: "a x²", 5: "b", 6: "c\td. e"} and sent.value == 2
