"""Token ids and padded batches against a plain version, with a vocabulary made here."""

import pytest

tokenizers = pytest.importorskip("tokenizers")

from quillspark.operators import tokens  # noqa: E402


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    words = ["[UNK]", "read", "this", "a", "b", "c", "d"]
    made = tokenizers.Tokenizer(tokenizers.models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="[UNK]"))
    made.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    path = str(tmp_path_factory.mktemp("v") / "words.json")
    made.save(path)
    return path


def _rows(spark):
    rows = [(i, " ".join("abcdx"[(i + j) % 5] for j in range(i % 9)), " ".join("abc"[j % 3] for j in range(i % 4))) for i in range(37)]
    return rows + [(None, None, None), (5, "", "a"), (5, "", "a")], spark.createDataFrame(rows + [(None, None, None), (5, "", "a"), (5, "", "a")], "id long, x string, y string")


def _ids(text, most):
    return [{"read": 1, "this": 2, "a": 3, "b": 4, "c": 5, "d": 6}.get(w, 0) for w in text.split()][:most]


def test_ids(spark, vocabulary):
    rows, df = _rows(spark)
    got = tokens.tokenised(df.withColumnRenamed("id", "c1.d"), "x", "y", vocabulary, "read this ", 6, 2)
    assert got.columns == ["c1.d", "x", "y", "input_ids", "labels"]
    want = [(i, _ids("read this " + (x or ""), 6), _ids(y or "", 2)) for i, x, y in rows]
    assert sorted(map(str, want)) == sorted(str((r["c1.d"], r["input_ids"], r["labels"])) for r in got.collect())


def test_batches_hold_every_row_once(spark, vocabulary):
    rows, df = _rows(spark)
    made = tokens.tokenised(df, "x", "y", vocabulary, "", 6, 2)
    out = tokens.batches(made, "id", 4, pad=9, partitions=3).collect()
    got, spent = [], 0
    for b in out:
        assert len(b["keys"]) == b["rows"] <= 4 and len(b["input_ids"]) == len(b["attention_mask"]) == b["rows"] * b["width"]
        lengths = []
        for i, k in enumerate(b["keys"]):
            ids, mask = (b[c][i * b["width"] : (i + 1) * b["width"]] for c in ("input_ids", "attention_mask"))
            labels = b["labels"][i * b["label_width"] : (i + 1) * b["label_width"]]
            n = sum(mask)
            assert mask == [1] * n + [0] * (b["width"] - n) and ids[n:] == [9] * (b["width"] - n)
            lengths.append(n)
            got.append((k, ids[:n], [x for x in labels if x != tokens.MASKED]))
        assert b["width"] == max(lengths) and lengths == sorted(lengths)
        spent += len(b["input_ids"]) - sum(b["attention_mask"])
    want = [(None if i is None else str(i), _ids(x or "", 6), _ids(y or "", 2)) for i, x, y in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(b["rows"] < 4 for b in out) <= 3 and spent < sum(len(w[1]) for w in want) / 2
    assert tokens.batches(made.limit(0), "id").count() == 0


def test_first_ids_are_those_of_the_whole_text(tmp_path):
    """A byte-level vocabulary encodes only as many pieces as are asked for, whatever the white space; others encode whole texts."""
    texts = ["it's  a\ttest of 12 3456 words, it's", "the theme  ", " leading", "a \n b", "x" * 50, "", " ", "é ü  — end<|end|> the <|end|>", "a b the  c", "the the the the " * 9]
    made = tokenizers.Tokenizer(tokenizers.models.BPE())
    made.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.train_from_iterator(texts * 3, tokenizers.trainers.BpeTrainer(vocab_size=330, special_tokens=["<|end|>"], show_progress=False, initial_alphabet=tokenizers.pre_tokenizers.ByteLevel.alphabet()))
    made.save(path := str(tmp_path / "bytes.json"))
    made.encode_special_tokens = True
    encoder = tokens.Encoder(path)
    assert encoder.pieces
    for t in texts:
        want = made.encode(t, add_special_tokens=False).ids
        for most in (0, 1, 2, 3, 7, 1000):
            assert encoder.first(t, most) == want[:most]
    asked = []
    encoder.known.clear()
    encoder.whole = type("Counted", (), {"encode": lambda self, t, **k: asked.append(t) or made.encode(t, **k)})()
    encoder.first("the theme of " + "words " * 500, 2)
    assert sum(map(len, asked)) < 20
