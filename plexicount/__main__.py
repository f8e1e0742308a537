import sys

from plexicount.cli import main

sys.exit(main())
