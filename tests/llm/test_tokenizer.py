"""The cached tokenizer gives the ids of the plain one, whatever parts it puts a string together from."""

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperlane.llm.packing import CachedTokenizer
from paperlane.llm.queries import tokenizer_path

PLAIN, CACHED = Tokenizer.from_file(tokenizer_path()), CachedTokenizer(tokenizer_path())
EDGES = ["don't STOP.", "foo<|endoftext|> bar", "<|endoftext|>", "H̱a ẖ, é,", "İstanbul, ΣΑΣ. ǅ! ǰ", "a×b ÷ c", "\t tab\rx\x1cy", "", "  ", "ﬁn, x²y 1234,", "it's,'s 's! a'", "日本、x!", "ªB Ⱥ!", "Grüße, ÉCOLE!!!"]


def same(texts: list[str]) -> None:
    assert [x.tolist() for x in CACHED.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_edges():
    same(EDGES)
    same(EDGES)
    assert CACHED.encode([]) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBzÉéßİĀǅȺ0'’.,!<|> \n\t×ªµ̱́Σ日"), max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    same(texts)
