"""python -m siltstone STORE QUERY...: vector and hybrid search of a store side by side, as Markdown."""

from __future__ import annotations

import sys

from siltstone import runtime
from siltstone.operators import embedding, service


def main(store: str, *texts: str) -> int:
    spark = runtime.session()
    rows = service.compare(spark, store, list(texts), embedding.HashedTerms()).orderBy("query_id").collect()  # a row for each query given
    print("# Comparison of retrieval\n")
    print("\n\n".join(r["report"] for r in rows))
    runtime.release(spark)
    return 0


if __name__ == "__main__":
    if len(sys.argv) < 3:
        sys.exit(__doc__)
    sys.exit(main(*sys.argv[1:]))
