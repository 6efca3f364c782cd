import json

import public_tokenizers
import pytest

from evalsmith.llm import token_counts


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}}, {"model": {"ignore_merges": True}}, {"model": {"type": "WordPiece"}}, {"added_tokens": [{"content": "<x>", "lstrip": True}]},
])
def test_other_files_are_refused(tmp_path, change):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert token_counts.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))["specials"]
    for k, v in change.items():
        spec[k] = spec[k] | v if k == "model" else v
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="isn't built"):
        token_counts.load_vocabulary(str(path))
