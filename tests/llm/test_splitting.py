import pytest

from conceptmill.llm.splitting import cut, split_texts
from conceptmill.llm.tokens import encoder

WORDS = "The alternative label was dropped because readers took it for a survey. "
TEXTS = {
    "prose": "\n\n".join(WORDS * 7 for _ in range(12)),
    "lines": "\n".join(WORDS * 2 for _ in range(30)),
    "no blanks": "x9é漢" * 700,
    "emoji": "👩‍👩‍👧" * 300,
    "blanks": " " * 3000 + "a" + "\n" * 2000,
    "windows": "\r\n\r\n".join(["mineral wool"] * 400),
    "no sentence": "mineral wool " * 500,
    "cjk": "概念の階層は大きい。" * 200,
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(100, 0), (64, 16), (256, 32)])
def test_pieces(name, limit, overlap):
    text = TEXTS[name]
    enc = encoder()
    got = cut(text, limit, overlap)
    n = len(enc.encode_ordinary(text))
    assert bool(got) == (n > limit)
    if not got:
        return
    assert got[0][0] == 0 and got[-1][1] == len(text) and got[-1][4] == "end"
    assert all(len(enc.encode_ordinary(text[a:b])) == size <= limit for a, b, size, _, _ in got)
    for (_, b, _, _, kind), (a2, b2, _, shared, _) in zip(got, got[1:]):
        assert a2 <= b < b2 and overlap <= shared <= overlap + 3
        assert kind != "end"
        if kind != "hard":
            assert text[b - 1].isspace() or text[b].isspace()
    kinds = {k for *_, k in got[:-1]}
    assert kinds <= {"prose": {"paragraph", "sentence", "line"}, "no blanks": {"hard"}, "emoji": {"hard"}, "lines": {"line", "sentence", "word"}, "no sentence": {"word"}, "cjk": {"hard"}}.get(name, kinds)


def test_frame(spark):
    rows = [(1, TEXTS["prose"]), (2, "short"), (3, None), (4, ""), (1, TEXTS["prose"]), (None, TEXTS["lines"])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, body string, piece int, text string")
    got = split_texts(df, "doc_id", "body", 200, 20).collect()
    assert {r["doc_id"] for r in got} == {1, None}
    whole = [r for r in got if r["doc_id"] is None]
    assert [r["piece"] for r in whole] == list(range(whole[0]["n_pieces"]))
    assert all(TEXTS["lines"][r["first_char"] : r["end_char"]] == r["text"] for r in whole)
    with pytest.raises(ValueError):
        split_texts(df, "doc_id", "body", 20, 20)


def test_empty(spark):
    assert split_texts(spark.createDataFrame([], "id long, t string"), "id", "t").collect() == []
