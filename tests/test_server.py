"""The HTTP protocol, deadlines and reader options."""

import threading
import urllib.error
import urllib.parse
import urllib.request

import pytest

from tessera.engine import DeadlineExceeded, cancel, deadline
from tessera.server import serve
from tessera.sources import rdf
from tessera.store import Store


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    server = serve(Store(spark, f"file://{tmp_path_factory.mktemp('s')}/store"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def ask(url, method="GET", body=None, **headers):
    r = urllib.request.Request(url, body, {k.replace("_", "-"): v for k, v in headers.items()}, method=method)
    try:
        with urllib.request.urlopen(r) as got:
            return got.status, got.headers["Content-Type"], got.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.headers["Content-Type"], e.read().decode()


def test_protocol(url):
    q = lambda text, **more: f"{url}/sparql?" + urllib.parse.urlencode({"query": text, **more})
    assert ask(f"{url}/health")[::2] == (200, "ok\n")
    assert ask(f"{url}/graphs?graph=http://x/g", "PUT", b"<http://x/a> <http://x/p> 1, 'b' .", Content_Type="text/turtle")[0] == 204
    assert ask(f"{url}/graphs?default", "POST", b"<http://x/a> <http://x/p> <http://x/o> .\n", Content_Type="application/n-triples")[0] == 204
    assert ask(f"{url}/sparql", "POST", b"INSERT DATA { <http://x/new> <http://x/p> 2 }", Content_Type="application/sparql-update")[0] == 204
    status, kind, text = ask(q("SELECT (COUNT(*) AS ?n) { ?s ?p ?o }"), Accept="text/csv")
    assert (status, kind, text.split()) == (200, "text/csv; charset=utf-8", ["n", "2"])
    assert '"value":"2"' in ask(q("SELECT (COUNT(*) AS ?n) { ?s ?p ?o }", **{"default-graph-uri": "http://x/g"}))[2]
    assert "true" in ask(f"{url}/sparql", "POST", b"ASK { GRAPH ?g { ?s ?p 'b' } }", Content_Type="application/sparql-query")[2]
    form = urllib.parse.urlencode({"query": "CONSTRUCT WHERE { ?s ?p ?o }"}).encode()
    assert len(ask(f"{url}/sparql", "POST", form, Content_Type="application/x-www-form-urlencoded")[2].splitlines()) == 2
    assert sorted(ask(f"{url}/graphs?graph=http://x/g")[2].splitlines())[1].endswith("\"b\" .")
    assert ask(f"{url}/graphs?graph=http://x/g", "DELETE")[0] == 204 and ask(f"{url}/graphs?graph=http://x/g")[0] == 404
    assert [ask(x)[0] for x in (q("SELECT nonsense"), f"{url}/sparql", f"{url}/graphs", f"{url}/no")] == [400, 400, 400, 404]
    assert ask(q("ASK {}"), Accept="image/png")[0] == 406 and ask(f"{url}/sparql", "POST", b"x", Content_Type="text/html")[0] == 415


def test_deadline(spark):
    slow = spark.range(0, 4, 1, 4).selectExpr("java_method('java.lang.Thread', 'sleep', cast(20000 as bigint))")
    with pytest.raises(DeadlineExceeded), deadline(spark, 1.0):
        slow.collect()
    with pytest.raises(Exception, match="(?i)cancel"), deadline(spark, 60.0) as group:
        threading.Timer(1.0, cancel, (spark, group)).start()
        slow.collect()
    with deadline(spark, 60.0):
        assert spark.range(3).count() == 3


def test_reader_options(spark, tmp_path):
    (tmp_path / "d.nt").write_text('<http://x/a> <http://x/p> "1" .\nnot a statement\n<http://x/a> <http://x/p> "x"@ar--rtl .\n<http://x/a> <http://x/p> <<( <http://x/a> <http://x/p> "1" )>> .\n')
    path = f"file://{tmp_path}/d.nt"
    assert rdf.read(spark, path, lenient=True).count() == 3 and rdf.read(spark, path, lenient=True, spec12=False).count() == 1
    with pytest.raises(Exception, match="not a statement|expected"):
        rdf.read(spark, path).collect()
