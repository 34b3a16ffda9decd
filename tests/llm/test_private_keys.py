"""A private key is found and redacted with its body."""

from tracewright.llm import secrets

LINES = ["MIIEpAIBAAKCAQEA" + c * 48 for c in "abcdefgh"]
HEAD, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
BODY = "\n".join([*LINES, "Zz09+/=="])


def test_redaction_leaves_no_key_body(make_docs):
    rows = [
        (0, f"before\n{HEAD}\n{BODY}\n{END}\nafter"),
        (1, f"before\n{HEAD}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{BODY}\n{END}\nafter"),
        (2, f"before\n{HEAD}\n{BODY}\nafter the key, more words"),
        (3, f"before\n{HEAD}\n{BODY}"),
        (4, '{"key": "' + f"{HEAD}\n{BODY}\n{END}\n".replace("\n", "\\n") + '"}'),
        (5, f"the line {HEAD} begins a key"),
        (6, f"{HEAD}\n{BODY}\n{END}\nbetween\n{HEAD}\n{BODY}\n{END}\nafter"),
        (7, f"{HEAD}\n" + "\n".join(LINES * 40) + f"\n{END}\nafter"),
        (8, f"{HEAD}\n{BODY}\n-----EN"),
    ]
    out = {r.doc_id: r.text for r in secrets.redact_history(make_docs(rows))[0].collect()}
    assert out == {
        0: "before\n[SECRET]\nafter",
        1: "before\n[SECRET]\nafter",
        2: "before\n[SECRET]\nafter the key, more words",
        3: "before\n[SECRET]",
        4: '{"key": "[SECRET]\\n"}',
        5: "the line [SECRET] begins a key",
        6: "[SECRET]\nbetween\n[SECRET]\nafter",
        7: "[SECRET]\nafter",
        8: "[SECRET]\n-----EN",
    }


def test_ledger_of_the_header_rule_is_scanned_again(make_docs):
    docs = make_docs([(0, f"{HEAD}\n{BODY}\n{END}")])
    _, ledger = secrets.scan_history(docs)
    old = ledger.selectExpr("blob", "transform(rules, r -> replace(r, 'private_key:2', 'private_key:1')) AS rules", "transform(findings, f -> named_struct('start', f.start, 'rank', f.rank, 'end', 31, 'kind', f.kind)) AS findings")
    again = secrets.scan_history(docs, old)[0].first().findings
    assert [(f.kind, f.start, f.end) for f in again if f.kind == "private_key"] == [("private_key", 0, len(f"{HEAD}\n{BODY}\n{END}"))]


def test_redaction_looks_known_blobs_up(make_docs):
    """A second run over the same blobs runs no pattern, its gate neither, and returns the same texts and ledger."""
    rows = [(0, f"a {HEAD}\n{BODY}\n{END} b"), (1, "clean"), (2, None), (3, "token = abcdef123"), (3, "token = abcdef123")]
    first, ledger = secrets.redact_history(make_docs(rows))
    texts = sorted((r.doc_id, r.text or "") for r in first.collect())
    assert texts[0] == (0, "a [SECRET] b") and ledger.count() == 4
    broken = tuple(secrets.Rule(r.kind, r.version, "[a-z]", ".*", "[a-z]", r.base) for r in secrets.RULES)  # would find every letter
    second, again = secrets.redact_history(make_docs([*rows, (9, "clean")]), rules=broken, ledger=ledger)
    assert sorted((r.doc_id, r.text or "") for r in second.collect()) == [*texts, (9, "clean")]
    assert {(bytes(r.blob), len(r.findings)) for r in again.collect()} == {(bytes(r.blob), len(r.findings)) for r in ledger.collect()}
