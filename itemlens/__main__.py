import sys

from itemlens.cli import main

sys.exit(main())
