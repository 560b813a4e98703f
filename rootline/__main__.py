from rootline.cli import main

raise SystemExit(main())
