import sys

from patternloom.runtime import main

sys.exit(main())
