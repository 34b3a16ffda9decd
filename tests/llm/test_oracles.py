"""Every registered text query that has SQL against it."""

import pytest
from tests.oracle import compare

from tracewright.llm import registry, secrets
from tracewright.llm.oracles import SECRETS


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, name):
    assert compare(spark, sf_dir, name, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_private_keys_in_sql(make_docs):
    """The SQL of the key rule, which has no look-ahead, on every shape of a key."""
    import duckdb

    line = "MIIEpAIBAAKCAQEA" + "a" * 48
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    bodies = [f"{line}\n{line}\nZz09+/==", f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n{line}\nab=", line, "", "no key, a-b --- c", f"{line}\n{line}!\nab", f"{line}\nabc def", f"{line}\nabc  -----END"]
    texts = [f"x {head}\n{b}{tail}" for b in bodies for tail in ("", f"\n{end}\nafter", "\nmore words", f"\n------{end}", "\\nafter")]
    texts += [t.replace("\n", "\\n") for t in texts] + [texts[1] + texts[1], ""]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {r.doc_id: r.spans for r in secrets.secret_digest(secrets.scan_history(make_docs(list(enumerate(texts))))[0]).collect()}
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, spans FROM ({SECRETS})").fetchall()}
    assert {k: (got[k], texts[k]) for k in got} == {k: (want[k], texts[k]) for k in want}
