"""python -m tessera query|update|load|export|compact|verify|serve|pipe ...: a thin command line."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    verb, *rest = args or ["help"]
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    from tessera.engine import query
    from tessera.operators.update import update
    from tessera.sources import rdf, results
    from tessera.store import Store
    from tessera.streaming import pipeline

    if verb == "query":
        store, text, *syntax = rest
        print(results.text(query(Store(spark, store).snapshot(), text), syntax[0] if syntax else "json"))
    elif verb == "update":
        update(Store(spark, rest[0]), rest[1], loader=lambda iri: rdf.read(spark, iri))
    elif verb == "load":
        for path in rest[1:]:
            Store(spark, rest[0]).load(rdf.read(spark, path))
    elif verb == "export":
        rdf.write(Store(spark, rest[0]).quads(), rest[1])
    elif verb == "compact":
        Store(spark, rest[0]).compact()
    elif verb == "verify":
        return 0 if Store(spark, rest[0]).verify() else 1
    elif verb == "serve":
        from tessera.server import serve

        serve(Store(spark, rest[0]), port=int(rest[1]) if len(rest) > 1 else 8080).serve_forever()
    elif verb == "pipe":
        out = pipeline.run(spark, rest)
        if isinstance(out, int):
            print(out)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
