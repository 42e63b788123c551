import public_tokenizers
import pytest

from allelix.llm import packing
from allelix.llm.queries import vocabulary


@pytest.mark.parametrize("text", ["x<|endoftext|>", "<|endoftext|>", "a b <|endoftext|> c  d<|endoftext|><|endoftext|>e ", "<|endoftext| >"])
def test_ids_of_added_tokens(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    got = packing.encoder(vocabulary())(text)
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want
