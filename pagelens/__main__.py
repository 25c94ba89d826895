from pagelens.plans.cli import main

main()
