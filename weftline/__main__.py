"""python -m weftline --store URL COMMAND: a look at a store, and running what is in it."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from weftline import debug, draw
from weftline.flow import Flow
from weftline.model import Artefact, Error, Operation


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftline")
    out.add_argument("--store", help="folder or URL of the store (default: WEFTLINE_STORE)")
    out.add_argument("--log", default="warning", choices=["debug", "info", "warning", "error"], help="what is said of the steps that run")
    sub = out.add_subparsers(dest="command", required=True)
    for name, text in (
        ("cat", "print values"),
        ("execute", "compute"),
        ("reset", "forget results"),
        ("wait", "wait until computed"),
        ("graph", "print a DOT graph"),
        ("debug", "write all that is known to a folder"),
        ("clean", "drop error records of what is computed, and claims of runs that stopped"),
    ):
        p = sub.add_parser(name, help=text)
        p.add_argument("hashes", nargs="*")
        if name == "wait":
            p.add_argument("-t", "--timeout", type=float)
        if name == "debug":
            p.add_argument("-o", "--output")
        if name == "graph":
            p.add_argument("-i", "--inputs", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    logging.basicConfig(level=args.log.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    flow = Flow(args.store)

    def single(prefix: str, *types: type):
        found = [x for x in flow.find(prefix) if isinstance(x, types or (Artefact, Operation))]
        if len(found) != 1:
            print(f"{prefix}: {len(found)} matches", file=sys.stderr)
        return found[0] if len(found) == 1 else None

    targets = [single(h) for h in args.hashes]
    if args.command == "clean":
        flow.forget_runs()
        for key in list(flow.store.keys("errors")):
            if flow.status(key).name != "error":
                flow.store.drop("errors", key)
        return 0
    if args.command == "graph" and not args.hashes:
        targets = [flow.operation(k) for k in flow.store.keys("operations")]
    if None in targets:
        if args.command != "reset":
            return 2
        return 1  # an unclear prefix resets nothing
    if args.command == "cat":
        for t in targets:
            value = flow.read(t.hash) if isinstance(t, Artefact) else None
            if isinstance(value, bytes):
                sys.stdout.buffer.write(value)
                sys.stdout.buffer.flush()
            elif isinstance(value, Error):
                print(f"{value.kind.value} from {value.source}\n{value.details or ''}", file=sys.stderr)
            else:
                print(value if isinstance(value, str) else json.dumps(value))
    elif args.command == "execute":
        flow.execute(*(t.hash for t in targets))
    elif args.command == "reset":
        for t in targets:
            flow.reset(t.hash)
    elif args.command == "wait":
        try:
            flow.wait([h for t in targets for h in ([t.hash] if isinstance(t, Artefact) else t.out.values())], args.timeout, poll=0.5)
        except TimeoutError:
            return 2
    elif args.command == "graph":
        hashes = [t.hash for t in targets]
        print(draw.to_dot(draw.outline(flow, hashes), args.inputs))
    elif args.command == "debug":
        for t in targets:
            debug.dump(t, args.output or t.hash[:6], connection=flow)
    return 0


if __name__ == "__main__":
    sys.exit(main())
