from quiver.cli import main

main()
