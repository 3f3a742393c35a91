from .plans.recipes import main

main()
