"""``python -m rootline serve|export|page|compact STORE``"""

from __future__ import annotations

import argparse

from rootline.session import create_session
from rootline.sources import page
from rootline.sources.store import LineageStore


def main(args: list[str] | None = None) -> int:
    """Run a command on a store."""
    parser = argparse.ArgumentParser(prog="rootline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("serve", "show the store in a browser"), ("export", "write the metadata of each node beside it"), ("page", "write the store as one page"), ("compact", "drop what nothing uses")):
        sub = commands.add_parser(name, help=about)
        sub.add_argument("store")
        if name == "serve":
            sub.add_argument("--port", type=int, default=0)
        if name in ("export", "page"):
            sub.add_argument("--dest")
    asked = parser.parse_args(args)
    with LineageStore(asked.store, create_session()) as store:
        if asked.command == "serve":
            server = page.serve(store, asked.port)
            print(f"http://127.0.0.1:{server.server_port}/  (Enter ends)", flush=True)
            input()
            server.shutdown()
        elif asked.command == "export":
            print(store.export_metadata(asked.dest))
        elif asked.command == "page":
            print(page.export(store, asked.dest))
        else:
            print(f"{store.compact()} chunks dropped")
    return 0
