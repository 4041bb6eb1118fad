from lectern.cli import main

main()
