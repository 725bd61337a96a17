from skyledger.cli import main

if __name__ == "__main__":
    import sys
    main(sys.argv[1:])
