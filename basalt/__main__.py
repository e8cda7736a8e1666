import sys

from basalt.cli import main

sys.exit(main())
