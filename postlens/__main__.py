import sys

from postlens.jobs import main

sys.exit(main())
