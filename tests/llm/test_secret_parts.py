"""Secrets within addresses, paths and longer runs, of letters alone, and short ones."""

import random
import string

import pytest
import tiktoken

from panelcast.llm import secret_scan as s

KEY = "q8Zk3vXw9LpT2mNb7RdY"


@pytest.fixture(scope="module")
def found():
    encoding = tiktoken.Encoding("t", pat_str=s.PATTERN, mergeable_ranks=s.load_ranks(), special_tokens={})
    count = lambda key: len(encoding.encode_ordinary(key))
    return lambda text: [text[a:b] for kind, a, b in s.secret_spans(text, count) if kind == "token"]


def test_keys_in_addresses_are_found(found):
    assert found(f"postgres://app:{KEY}5hJc1GsF@db.internal/main") == [KEY + "5hJc1GsF"]
    assert found(f"see app:{KEY}@db.example.com now") == [KEY]
    assert found(f"https://hooks.slack.com/services/T0A1B2C3D/B0E4F5G6H/{KEY}Qw5x") == [KEY + "Qw5x"]
    assert found(f"https://{KEY}@git.example.com/a/b") == [KEY]
    for quiet in ("mailto:some.person42@mail7.example.com", "https://d111111abcdef8xk2.cloudfront.net/assets/style.css",
                  "https://user@host.example.com:8080/some-path/of_words/index.html", f"{KEY}@example.com"):
        assert found(quiet) == []


def test_keys_of_letters_short_keys_and_pieces_are_found(found):
    rng = random.Random(2)
    for letters, n in ((string.ascii_letters, 24), (string.ascii_lowercase, 32)):
        keys = ["".join(rng.choices(letters, k=n)) for _ in range(200)]
        assert sum(found(k) == [k] for k in keys) >= 180
    assert found("use q8Zk3vXw9LpT here") == ["q8Zk3vXw9LpT"]
    for prefix in ("application_environment_configuration_", "backups/production/configuration/database/"):
        assert found(prefix + KEY) == [KEY]
    for quiet in ("internationalization", "runs/123e4567-e89b-12d3-a456-426614174000", "AbstractSingletonProxyFactoryBean"):
        assert found(quiet) == []


def test_the_part_outside_a_base_span_stays(found):
    text = "Xk9Qz7Lw2Vb+" + "0123456789abcdef" * 2 + "+pR4tY8uN1mC"
    assert "".join(found(text)) == text.replace("0123456789abcdef" * 2, "")
