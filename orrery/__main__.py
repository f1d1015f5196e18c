from orrery.cli import main

raise SystemExit(main())
