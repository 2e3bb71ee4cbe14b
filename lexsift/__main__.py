"""``python -m lexsift INPUT_DIR OUTPUT.json [BRANCH...]``: analyzes the PDF files of a directory, stores the results and prints the summary."""

import sys

from pyspark.sql import SparkSession

from . import analyze_directory, summarize_results
from .sources.sinks import print_summary


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    SparkSession.builder.appName("lexsift").getOrCreate()
    found = analyze_directory(args[0], args[1], enabled_branches=args[2:] or None)
    print_summary(summarize_results(found.flat()))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
