"""python -m tidemark TABLE put KEY VALUE | get KEY | delete KEY | scan LOW HIGH | status | flush | compact

Prints JSON; values are base64, as they may be any bytes.
"""

from __future__ import annotations

import base64
import json
import sys


def run(spark, args: list[str]) -> dict:
    from .sources.kvtable import KVTable

    path, command, *rest = args
    b64 = lambda s: None if s is None else base64.b64encode(s.encode()).decode()
    with KVTable.open(spark, path) as t:
        match command, rest:
            case "put", [key, value]:
                return {"seq": t.put(key, value)}
            case "delete", [key]:
                return {"seq": t.delete(key)}
            case "get", [key]:
                found, value = t.get(key)
                return {"found": found, "value": b64(value)}
            case "scan", [low, high]:
                return {"pairs": [{"key": b64(r["key"]), "value": b64(r["value"])} for r in t.scan(low, high).toLocalIterator()]}
            case "status", []:
                return t.status().first().asDict()
            case "flush", []:
                t.flush()
            case "compact", []:
                t.compact()
            case _:
                raise SystemExit(__doc__)
    return {"ok": True}


def main() -> None:
    if len(sys.argv) < 3:
        raise SystemExit(__doc__)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    print(json.dumps(run(spark, sys.argv[1:])))


if __name__ == "__main__":
    main()
