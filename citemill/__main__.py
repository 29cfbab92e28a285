"""python -m citemill, or spark-submit with the package in --py-files."""

import sys

from citemill.cli import main

sys.exit(main())
