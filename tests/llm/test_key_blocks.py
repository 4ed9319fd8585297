import random

import pytest

from tessera.llm import secrets


@pytest.mark.parametrize("label", ["", "RSA ", "OPENSSH "])
@pytest.mark.parametrize("line", ["\n", "\r\n", "\\n", " ", '\\n",\n  "'])
@pytest.mark.parametrize("end", [True, False])
def test_no_byte_of_a_private_key_is_left(label, line, end):
    rnd = random.Random(8)
    body = ["".join(rnd.choices("ABCDEFGHabcdefgh0123456789+/", k=n)) for n in (64, 64, 64, 11)]
    head = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0011223344556677"] if label == "RSA " and line != " " else []
    block = line.join([f"-----BEGIN {label}PRIVATE KEY-----", *head, *body, *([f"-----END {label}PRIVATE KEY-----"] if end else [])])
    found = secrets.scan("before\n" + block + "\n. after it, all stays")
    assert found[0] == ("key_block", 7, 7 + len(block))
    assert secrets.redact("before\n" + block + "\n. after it, all stays", found) == "before\n<key_block>\n. after it, all stays"


def test_key_blocks_end_where_they_should():
    one = "-----BEGIN PRIVATE KEY-----\nMIIB\n-----END PRIVATE KEY-----"
    assert secrets.redact(f"{one} text {one}", secrets.scan(f"{one} text {one}")) == "<key_block> text <key_block>"
    cut = "-----BEGIN PRIVATE KEY----- is how such a header looks"
    assert secrets.redact(cut, secrets.scan(cut)) == "<key_block> is how such a header looks"
    many = "-----BEGIN PRIVATE KEY-----\n" * 50_000
    assert len(secrets.scan(many)) == 50_000
