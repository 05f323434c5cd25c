import sys

from loomdex.cli import main

sys.exit(main())
