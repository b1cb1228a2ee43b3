"""Texts encoded together: the library's ids, with transitions looked up for many pieces at once."""

import random
import sys

import pyarrow as pa
import pyarrow.compute as pc
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_texts_together_are_the_librarys_encoding(monkeypatch):
    import tiktoken

    from stintlab.llm import bpe

    path = bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc  \n\n\t'sdtreé漢字🙂ßñ 0123.,-_!  \x1c\x85\xa0 　") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(rng.choice("abe ,.\n") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [None, "", "\n", " ", "a\n", "a\n\n", "a\n\nb", "\n\nb", " \n", "x" * 63, "é" * 40, "we'll I'll, 's"]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (63, 64, 65, 300, 40_000)]
    for most, long, part in ((bpe.MAX_KEPT, bpe.VERY_LONG, bpe.PART), (200, 20, 3)):  # the second starts the tables again and again
        monkeypatch.setattr(bpe, "VERY_LONG", long)
        monkeypatch.setattr(bpe, "PART", part)
        c = bpe.Codec(path, max_kept=most)
        for _ in range(2):  # words not seen before, then seen ones
            ids, ends = c.encode_all(texts)
            assert len(ends) == len(texts) and ends[-1] == len(ids)
            for t, a, b in zip(texts, [0, *ends], ends):
                assert ids[a:b].tolist() == library.encode_ordinary(t or ""), t
                assert c.decode(ids[a:b]) == (t or "")
    ids, ends = c.encode_all([])
    assert len(ids) == len(ends) == 0


def test_odd_white_space_is_all_that_the_pattern_calls_so():
    import regex

    from stintlab.llm import bpe

    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    found = pc.match_substring_regex(pa.array([f"a{x}b" for x in every], pa.large_string()), bpe._ODD).to_pylist()
    white = regex.compile(r"[^\S \n]")
    assert not [x for x, f in zip(every, found) if not f and (white.match(x) or x.isspace() and x not in " \n")]
    assert sum(found) < 40


def test_a_transition_is_looked_up_once_for_many_words():
    from stintlab.llm import bpe

    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

    c = bpe.Codec(bpe.default_vocabulary())
    table = c.transducer._next = Counted()
    rng = random.Random(2)
    made = {"".join(rng.choice(["qu", "eth", "ion", "ra", "wh"]) for _ in range(5)) for _ in range(3000)}
    c.encode_all([" ".join(sorted(made))])
    assert 0 < table.asked < sum(map(len, made)) / 4
